"""Schemas of the tables that operators read and write."""

from __future__ import annotations

MANIFEST = "path string, size bigint, mtime bigint"
INDEX = "source_path string, fingerprint string, note_path string, ord bigint"
EVENT = "project string, event_date date, note_filename string, subfolder string, content_confidence string, summary_hint string, fallback_hint string, parties array<string>, ord bigint"
LOG = "timestamp string, event_type string, summary string, details string, ord bigint"

# Fixed values of the note schema, in their canonical order.
FIELD_ORDER = [
    "schema_version", "plugin", "domain", "project", "source_path", "file_type", "captured_date", "event_date", "event_date_source", "scan_type",
    "sources_read", "read_bytes", "content_confidence", "attachments", "source_images", "images_embedded", "image_captions", "tags", "cssclasses",
]
OPTIONAL = ["attachments", "source_images", "images_embedded", "image_captions", "tags", "cssclasses", "sources_read"]
REQUIRED = [f for f in FIELD_ORDER if f not in OPTIONAL]
LISTS = ["sources_read", "attachments", "source_images", "image_captions", "tags", "cssclasses"]
V1_FIELDS = [f for f in FIELD_ORDER if f not in ("domain", "source_images", "images_embedded", "image_captions", "tags")]
V1_REQUIRED = [f for f in V1_FIELDS if f != "attachments"]
DATES = ["captured_date", "event_date"]
INTEGERS = ["schema_version", "read_bytes", "images_embedded"]
FILE_TYPES = [
    "folder", "image-folder", "pdf", "docx", "pptx", "xlsx", "jpg", "png", "psd", "ai", "dxf", "dwg", "rvt", "3dm", "mov", "mp4", "md", "txt", "html", "csv", "json",
    "key", "numbers", "pages", "odt", "ods", "odp", "zip", "rar", "7z", "tar", "url", "webloc", "eml", "msg", "other",
]
ENUMS = {
    "file_type": FILE_TYPES,
    "event_date_source": ["filename-prefix", "parent-folder-prefix", "mtime"],
    "scan_type": ["retro", "heartbeat", "manual"],
    "content_confidence": ["high", "low", "metadata-only"],
}
SCHEMA_VERSION = 2
INDEX_NOTE_TYPE = "project-index"
INDEX_NOTE_REQUIRED = ["schema_version", "plugin", "domain", "project", "note_type"]
INDEX_NOTE_OPTIONAL = ["status", "timeline_start", "timeline_end", "parties", "budget", "tags", "cssclasses"]
INDEX_NOTE_STATUS = ["active", "on-hold", "completed", "archived"]
#: Extensions whose file type isn't the extension itself.
TYPE_OF_EXTENSION = {"jpeg": "jpg", "gif": "jpg", "webp": "jpg", "bmp": "jpg", "htm": "html"}

# The categories of file types and their extensions.
CATEGORIES = {
    "document-pdf": ["pdf"],
    "document-office": ["docx", "pptx", "xlsx"],
    "document-office-legacy": ["doc", "ppt"],
    "spreadsheet-legacy": ["xls"],
    "image-raster": ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "tif", "heic", "heif"],
    "image-vector": ["svg", "eps"],
    "vector-ai": ["ai"],
    "raster-psd": ["psd"],
    "cad-dxf": ["dxf"],
    "cad-dwg": ["dwg"],
    "cad-3dm": ["3dm"],
    "video": ["mp4", "mov", "avi", "mkv", "wmv", "m4v", "webm"],
    "audio": ["mp3", "wav", "flac", "aac", "ogg", "m4a"],
    "text-plain": ["txt", "md", "rst", "csv"],
    "archive": ["zip", "rar", "7z", "tar"],
}
SKIPPED_CATEGORIES = ["video", "audio", "archive"]
