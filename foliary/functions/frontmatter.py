"""[A16] Frontmatter of notes, from text to typed values, by built-in functions.

A fence is cut into records, one for each top-level key, and each record goes through steps
that add fields to a struct, so that no expression is written out twice. What a record holds is
one of: block list, flow list, block scalar, quoted scalar, plain scalar over one or more
lines, map, nothing. Lists come out as JSON arrays of strings (null items as null), maps as JSON
objects; items that are lists or maps themselves are kept as their text. Anchors, tags and
aliases have no meaning here and stay text. Of a repeated key the last value counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
SINGLE = r"'[^']*+(?:''[^']*+)*+'"
KEY = rf"""(?:{DOUBLE}|{SINGLE}|(?:[^\s#\-\[\]{{}},&*!|>%@`"'?:]|[\-?:](?=\S))(?:[^\n:]|:(?=[^\s]))*?)"""
COMMENT_TAIL = r"[ \t]*(?:(?<=[ \t])#[^\n]*)?"
BLOCK = r"^[|>][+\-0-9]{0,2}" + COMMENT_TAIL + r"(?=\n|\z)"

# How plain scalars are read, in the order in which they are tried.
RESOLVE = [
    ("bool", r"^(?:yes|Yes|YES|no|No|NO|true|True|TRUE|false|False|FALSE|on|On|ON|off|Off|OFF)$"),
    ("float", r"^(?:[-+]?(?:[0-9][0-9_]*)\.[0-9_]*(?:[eE][-+][0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?|[-+]?[0-9][0-9_]*(?::[0-5]?[0-9])+\.[0-9_]*|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$"),
    ("int", r"^(?:[-+]?0b[0-1_]+|[-+]?0[0-7_]+|[-+]?(?:0|[1-9][0-9_]*)|[-+]?0x[0-9a-fA-F_]+|[-+]?[1-9][0-9_]*(?::[0-5]?[0-9])+)$"),
    ("null", r"^(?:~|null|Null|NULL|)$"),
    ("date", r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[Tt]|[ \t]+)[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]*)?(?:[ \t]*(?:Z|[-+][0-9]{1,2}(?::[0-9]{2})?))?)$"),
]


def fence_of(note: Column) -> Column:
    """The text between the first two lines of ---; null for a note that doesn't begin with a fence."""
    found = F.regexp_extract(note, r"(?s)\A\x{FEFF}?---[ \t]*\r?\n(.*?\n)?---[ \t]*(?:\r?\n|\z)", 0)
    return F.when(found != "", F.regexp_replace(F.regexp_replace(found, r"\A\x{FEFF}?---[ \t]*\r?\n", ""), r"---[ \t]*(?:\r?\n)?\z", ""))


def body_of(note: Column) -> Column:
    """What follows the fence; all of a note without one."""
    return F.regexp_replace(note, r"(?s)\A\x{FEFF}?---[ \t]*\r?\n(?:.*?\n)?---[ \t]*(?:\r?\n|\z)", "")


def folded(text: Column) -> Column:
    """Lines of a flow scalar as one: a break is a space, n empty lines are n breaks."""
    lines = F.regexp_replace(F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n"), r"(?<!\n)\n(?!\n)", " ")
    return F.regexp_replace(lines, r"\n(\n+)", "$1")


def undoubled(text: Column) -> Column:
    return F.replace(folded(F.regexp_replace(text, r"(?s)^'(.*)'$", "$1")), F.lit("''"), F.lit("'"))


def unescaped(text: Column) -> Column:
    """A double-quoted scalar's text: its escapes are nearly those of JSON."""
    inner = folded(F.regexp_replace(F.regexp_replace(text, r'(?s)^"(.*)"$', "$1"), r"(?<!\\)((?:\\\\)*)\\\n[ \t]*", "$1"))
    odd = F.regexp_replace(inner, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    for letter, code in {"0": "0000", "a": "0007", "v": "000b", "e": "001b", " ": "0020", "N": "0085", "_": "00a0", "L": "2028", "P": "2029"}.items():
        odd = F.regexp_replace(odd, rf"(?<!\\)((?:\\\\)*)\\{letter}", rf"$1\\u{code}")
    parsed = F.from_json(F.concat(F.lit('["'), odd, F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"})
    return F.coalesce(F.get(parsed, F.lit(0)), inner)


def integer(text: Column) -> Column:
    """An integer's decimal digits, whatever it was written in."""
    sign, digits = F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), F.regexp_replace(text, r"^[-+]|_", "")
    base = lambda drop, b: F.conv(F.regexp_replace(digits, drop, ""), b, 10)
    sixty = F.aggregate(F.split(digits, ":"), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a * 60 + F.coalesce(x.try_cast("decimal(38,0)"), F.lit(0))).cast("decimal(38,0)")).cast("string")
    value = F.when(digits.rlike("^0b"), base("^0b", 2)).when(digits.rlike("^0x"), base("^0x", 16)).when(digits.rlike("^0[0-7]"), base("^0+(?=.)", 8)).when(digits.contains(":"), sixty).otherwise(digits)
    return F.when(value == "0", "0").otherwise(F.concat(sign, value))


def scalar(text: Column) -> Column:
    """kind, value, ok of one scalar, quoted or not, without comments."""
    whole = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    out = F.when(whole.rlike(rf"(?s)\A{DOUBLE}\z"), F.struct(F.lit("str").alias("kind"), unescaped(whole).alias("value"), F.lit(True).alias("ok")))
    out = out.when(whole.rlike(rf"(?s)\A{SINGLE}\z"), F.struct(F.lit("str").alias("kind"), undoubled(whole).alias("value"), F.lit(True).alias("ok")))
    out = out.when(whole.rlike(r"""\A["'\[{]"""), F.struct(F.when(whole.rlike(r"\A\["), "list").when(whole.rlike(r"\A\{"), "map").otherwise("str").alias("kind"), whole.alias("value"), whole.rlike(r"\A[\[{]").alias("ok")))
    plain = folded(whole)
    for kind, pattern in RESOLVE:
        value = {"int": integer(plain), "bool": F.when(F.lower(plain).isin("yes", "true", "on"), "true").otherwise("false"), "null": F.lit(None).cast("string")}.get(kind, plain)
        out = out.when(plain.rlike(pattern), F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(True).alias("ok")))
    return out.otherwise(F.struct(F.lit("str").alias("kind"), plain.alias("value"), (~plain.rlike(r":(?:\s|$)|^[%@`&*!|>]") | F.lit(False)).alias("ok")))


def uncommented(text: Column) -> Column:
    """Without whole-line comments, and without what follows ' #' outside quotes."""
    lines = F.regexp_replace(text, r"(?:\A|\n)[ \t]*#[^\n]*(?=\n|\z)", "")
    return F.regexp_replace(lines, rf"""(?m)^((?:{DOUBLE}|{SINGLE}|(?<=[^\s,\[{{:])["']|[^"'\n])*?)[ \t]+#[^\n]*$""", "$1")


def records(fence: Column) -> Column:
    """array<struct<key, body, known>>: the top-level entries in order; those without a key aren't known."""
    text = F.regexp_replace(F.coalesce(fence, F.lit("")), r"\r\n", "\n")
    found = F.split(text, rf"(?<=\n)(?={KEY}[ \t]*:(?:[ \t]|\n|\z))")
    head = rf"(?s)\A({KEY})[ \t]*:(?:[ \t]+|(?=\n)|\z)"
    cut = F.transform(found, lambda r: F.struct(F.regexp_extract(r, head, 1).alias("key"), r.alias("text")))
    cut = F.filter(cut, lambda x: (x["key"] != "") | F.regexp_replace(x["text"], r"(?m)^[ \t]*(?:#[^\n]*)?$", "").rlike(r"\S"))
    return F.transform(cut, lambda x: F.struct(scalar_key(x["key"]).alias("key"), F.regexp_replace(x["text"], head, "").alias("body"), (x["key"] != "").alias("known")))


def scalar_key(key: Column) -> Column:
    return F.when(F.startswith(key, F.lit('"')), unescaped(key)).when(F.startswith(key, F.lit("'")), undoubled(key)).otherwise(F.trim(key))


def styled(record: Column) -> Column:
    """key, known, style, text: what kind of value a record has, and its text without comments."""
    bare = F.regexp_replace(uncommented(record["body"]), r"\s+\z", "")
    return F.struct(record["key"].alias("key"), record["known"].alias("known"), record["body"].alias("body"), bare.alias("bare"))


def told(record: Column) -> Column:
    bare = record["bare"]
    start = F.regexp_extract(bare, r"(?s)\A\s*(.*)\z", 1)
    style = (
        F.when(record["body"].rlike(r"(?s)\A[|>]") & record["body"].rlike("(?s)\\A" + BLOCK[1:]), "block")
        .when(bare.rlike(r"(?s)\A\n\s*-(?:\s|\z)"), "list")
        .when(start.rlike(r"\A\["), "flow")
        .when(start.rlike(r"\A\{"), "flow-map")
        .when(bare.rlike(rf"(?s)\A\n[ \t]+{KEY}[ \t]*:(?:\s|\z)"), "map")
        .otherwise("scalar")
    )
    return F.struct(record["key"].alias("key"), record["known"].alias("known"), record["body"].alias("body"), bare.alias("bare"), start.alias("start"), style.alias("style"))


def block_text(body: Column) -> Column:
    """A literal or folded block scalar, indented as its first line is or as it says, with its last line breaks
    as asked for. More-indented lines of a folded one are folded like the others."""
    head = F.regexp_extract(body, r"\A[^\n]*", 0)
    lines = F.regexp_replace(body, r"\A[^\n]*\n?", "")
    said = F.regexp_extract(head, r"\A[|>][+\-]?([1-9])", 1)
    indent = F.when(said != "", F.repeat(F.lit(" "), said.try_cast("int"))).otherwise(F.regexp_extract(lines, r"\A(?:[ \t]*\n)*( *)", 1))
    lines = F.regexp_replace(lines, F.concat(F.lit(r"(?s)(?:\A|(?<=\n))(?!"), indent, F.lit(r")(?=[^\n]*\S).*")), F.lit(""))
    own = F.regexp_replace(lines, F.concat(F.lit("(?m)^(?:"), indent, F.lit("|[ ]+$)")), F.lit(""))
    text = F.regexp_replace(own, r"\n+\z", "")
    end = F.substring(own, F.char_length(text) + 1, F.lit(1 << 30))
    text = F.when(F.startswith(head, F.lit(">")), F.regexp_replace(F.regexp_replace(text, r"(?<=[^\n])\n(?=[^\n])", " "), r"(?<=[^\n])\n(\n+)", "$1")).otherwise(text)
    keep = F.when(head.rlike(r"\A[|>][1-9]?-"), "").when(head.rlike(r"\A[|>][1-9]?\+"), end).otherwise(F.when(text == "", "").otherwise(F.left(end, F.lit(1))))
    return F.concat(text, keep)


def itemized(record: Column) -> Column:
    """key, known, style, body, start, items: the raw items of lists and maps."""
    bare, start = record["bare"], record["start"]
    indent = F.regexp_extract(bare, r"\A\s*\n([ ]*)", 1)
    lines = F.regexp_replace(F.regexp_replace(bare, r"\A\s*\n", ""), F.concat(F.lit("(?m)^"), indent), F.lit(""))
    of_list = F.transform(F.split(lines, r"\n(?=-(?:[ \t]|\n|\z))"), lambda x: F.regexp_replace(x, r"\A-[ \t]*", ""))
    of_map = F.split(lines, rf"\n(?={KEY}[ \t]*:(?:\s|\z))")
    token = rf"""{DOUBLE}|{SINGLE}|\[[^\[\]]*\]|\{{[^{{}}]*\}}|[^,\[\]{{}}"'\s][^,\[\]{{}}]*"""
    inside = F.regexp_replace(F.regexp_replace(start, r"\A[\[{]", ""), r"[\]}]\s*\z", "")
    pair = rf"""(?:{DOUBLE}|{SINGLE}|[^,:\[\]{{}}"'\s][^,:\[\]{{}}]*)\s*:(?:\s+(?:{DOUBLE}|{SINGLE}|\[[^\[\]]*\]|\{{[^{{}}]*\}}|[^,\[\]{{}}]*)|(?=[,}}]|\z))"""
    items = (
        F.when(record["style"] == "list", of_list)
        .when(record["style"] == "map", of_map)
        .when(record["style"] == "flow", F.regexp_extract_all(inside, F.lit(token), 0))
        .when(record["style"] == "flow-map", F.regexp_extract_all(inside, F.lit(pair), 0))
        .otherwise(F.array().cast("array<string>"))
    )
    closed = F.when(record["style"] == "flow", start.rlike(r"(?s)\A\[.*\]\z")).when(record["style"] == "flow-map", start.rlike(r"(?s)\A\{.*\}\z")).otherwise(F.lit(True))
    return F.struct(record["key"].alias("key"), record["known"].alias("known"), record["style"].alias("style"), record["body"].alias("body"), start.alias("start"), items.alias("items"), closed.alias("closed"))


def item_text(item: Column) -> Column:
    """The JSON value of one item."""
    nested = item.rlike(rf"(?s)\A(?:{KEY}[ \t]*:(?:\s|\z)|-(?:\s|\z)|[\[{{])")
    value = F.when(nested, F.trim(item)).otherwise(scalar(item)["value"])
    return value


def valued(record: Column) -> Column:
    """key, kind, value, ok."""
    style = record["style"]
    plain = scalar(record["start"])
    split = lambda x: F.struct(scalar_key(F.regexp_extract(x, rf"(?s)\A\s*({KEY})\s*:(?:\s|\z)", 1)).alias("k"), item_text(F.trim(F.regexp_replace(x, rf"(?s)\A\s*{KEY}\s*:(?:\s+|\z)", ""))).alias("v"))
    listed = F.to_json(F.transform(record["items"], item_text))
    mapped = F.regexp_replace(F.to_json(F.transform(record["items"], split), {"ignoreNullFields": "false"}), r'\{"k":("[^"\\]*+(?:\\.[^"\\]*+)*+"),"v":("[^"\\]*+(?:\\.[^"\\]*+)*+"|null)\}', "$1:$2")
    mapped = F.regexp_replace(F.regexp_replace(mapped, r"\A\[", "{"), r"\]\z", "}")
    is_list, is_map = style.isin("list", "flow"), style.isin("map", "flow-map")
    kind = F.when(is_list, "list").when(is_map, "map").when(style == "block", "str").otherwise(plain["kind"])
    value = F.when(is_list, listed).when(is_map, mapped).when(style == "block", block_text(record["body"])).otherwise(plain["value"])
    ok = record["known"] & record["closed"] & F.when(is_list | is_map | (style == "block"), F.lit(True)).otherwise(plain["ok"])
    return F.struct(record["key"].alias("key"), kind.alias("kind"), value.alias("value"), ok.alias("ok"))


def parsed(fence: Column) -> Column:
    """array<struct<key, kind, value, ok>> in the fence's order; kind is str, int, float, bool, null, date, list or map."""
    out = records(fence)
    for step in (styled, told, itemized, valued):
        out = F.transform(out, step)
    return out


def by_key(entries: Column, name: str) -> Column:
    """map<string,string> of what parsed gives: `name` (value or kind) by key."""
    known = F.filter(entries, lambda e: e["key"] != "")
    keys = F.array_distinct(F.transform(known, lambda e: e["key"]))
    plain = F.map_from_arrays(keys, F.transform(known, lambda e: e[name]))
    last = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(known, lambda e: e["key"] == k), -1)[name]))
    return F.when(F.size(keys) == F.size(known), plain).otherwise(last)


def well_formed(entries: Column) -> Column:
    """Whether the fence is a mapping that could be read whole."""
    return (F.size(entries) > 0) & F.forall(entries, lambda e: e["ok"])
