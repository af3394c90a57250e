"""Hosts of URLs and how far they are trusted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public suffixes of two labels, and the tiers' domains.
TWO_PART = ["co.uk", "com.cn", "co.jp", "co.nz", "co.za", "com.au", "com.br"]
TIERS = {
    1: ["wikipedia.org", "reuters.com", "bloomberg.com", "apnews.com", "ap.org", "bbc.com", "bbc.co.uk", "nytimes.com", "ft.com", "caixin.com", "caixinglobal.com", "xinhuanet.com"],
    2: ["techcrunch.com", "theverge.com", "36kr.com", "huxiu.com", "thepaper.cn", "jiemian.com", "archdaily.com", "dezeen.com", "designboom.com", "hbr.org", "theinformation.com"],
    3: ["mp.weixin.qq.com", "m.weibo.cn", "linkedin.com"],
    4: ["reddit.com", "quora.com", "zhihu.com", "xiaohongshu.com", "xhslink.com", "wordpress.com", "blogspot.com", "medium.com"],
}


def host(url: Column) -> Column:
    """Lower case, without port and 'www.'; of text without a scheme, what stands before the first slash."""
    found = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.substring_index(url, "/", 1), F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.lower(found), r":\d*$", ""), r"^www\.", "")


def registered_domain(url: Column) -> Column:
    """The last two labels, or three under a suffix of two."""
    parts = F.split(host(url), r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".")
    return F.when((F.size(parts) >= 3) & last(2).isin(TWO_PART), last(3)).otherwise(last(2))


def tier(url: Column, trusted: list[str] | None = None, tiers: dict[int, list[str]] | None = None) -> Column:
    """1 (authoritative) to 4 (anyone's); 3 if unknown. Trusted domains are 1."""
    own, name = host(url), registered_domain(url)
    trusted = [t.lower().removeprefix("www.").strip(".") for t in trusted or []]
    out = F.when(name.isin(trusted), 1) if trusted else F.when(F.lit(False), 1)
    for level, domains in (tiers or TIERS).items():
        out = out.when(name.isin(domains) | own.isin(domains), level)
    return F.coalesce(out.otherwise(3), F.lit(3))
