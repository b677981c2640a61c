"""Enumerations, limits and label texts that results depend on."""

from __future__ import annotations

# --- fixed values: enumerations -------------------------------------------------
CHANGE_TYPES = ["added", "removed", "modified"]
CONFIDENCES = ["low", "medium", "high"]
CONFIDENCE_PCT = {"low": 35, "medium": 65, "high": 90}
CATEGORIES = ["building", "house", "road", "bridge", "plot", "water", "vegetation", "other"]
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "gif"]

# --- fixed values: limits --------------------------------------------------------
MAX_IMAGE_BYTES = 150 * 1024 * 1024
FIT_BOUND = 3000
FRAME_MAX_DIM = 1536
RUN_FRAME_MAX_DIM = 2600
TILE_PX = 760
TILE_OVERLAP = 0.22
MAX_TILES = 16
TILE_OUT_PX = 1100
OVERVIEW_OUT_PX = 1500
DEDUPE_IOU = 0.4
RATIO_TEST = 0.75
MIN_FEATURES = 8
MIN_MATCHES = 12
RANSAC_PX = 5.0
MAX_OUTPUT_TOKENS = 8000
RAW_EXCERPT = 300
KEPT_BANDS = 3

# --- fixed values: defaults of missing or invalid fields ---------------------------
DEFAULT_CATEGORY = "other"
DEFAULT_CHANGE_TYPE = "modified"
DEFAULT_CONFIDENCE = "medium"
UNKNOWN_ERROR = "unknown error"

# --- fixed values: the sentence of runs without a summary, in four parts around the counts of changes and regions, and its plural ending
COUNTED_NOUN, COUNTED_PLURAL = " change", "s"
COUNTED_VERB, COUNTED_END = " detected across ", " regions."

# --- fixed values: patterns ----------------------------------------------------------
# Characters that web string trimming and the response pattern treat as white space.
WEB_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
DATA_URL_MARKER = ";base64,"
DATA_URL_HEAD = r"^data:(image/[a-zA-Z0-9.+-]+)\z"
FENCE_PATTERN = r"(?s)^```(?:json)?" + WEB_SPACE + r"*(.*?)" + WEB_SPACE + r"*```\z"
AUTH_STATUSES = [401, 403]
AUTH_PATTERN = r"(?i)\b40[13]\b|authentication|invalid x-api-key|api key not valid|permission"

# --- fixed values: label texts (language, key, template) -------------------------------
LABELS = [
    ("en", "type.added", "added"),
    ("en", "type.removed", "removed"),
    ("en", "type.modified", "modified"),
    ("en", "cat.building", "building"),
    ("en", "cat.house", "house"),
    ("en", "cat.road", "road"),
    ("en", "cat.bridge", "bridge"),
    ("en", "cat.plot", "plot"),
    ("en", "cat.water", "water"),
    ("en", "cat.vegetation", "vegetation"),
    ("en", "cat.other", "other"),
    ("en", "report.heading", "Change report ({n})"),
    ("en", "report.headingOf", "Change report ({n} of {total})"),
    ("en", "error.someFailed",
     "No usable answer for {failed} of the {total} tiles, so changes may be missing. First problem: {err}"),
    ("en", "error.allFailed", "None of the {total} tiles gave a usable answer ({failed} failures). First problem: {err}"),
    ("de", "type.added", "hinzugefügt"),
    ("de", "type.removed", "entfernt"),
    ("de", "type.modified", "verändert"),
    ("de", "cat.building", "Gebäude"),
    ("de", "cat.house", "Haus"),
    ("de", "cat.road", "Straße"),
    ("de", "cat.bridge", "Brücke"),
    ("de", "cat.plot", "Grundstück"),
    ("de", "cat.water", "Wasser"),
    ("de", "cat.vegetation", "Vegetation"),
    ("de", "cat.other", "Sonstiges"),
    ("de", "report.heading", "Veränderungsbericht ({n})"),
    ("de", "report.headingOf", "Veränderungsbericht ({n} von {total})"),
    ("de", "error.someFailed",
     "Zu {failed} von {total} Kacheln fehlt eine brauchbare Antwort, Veränderungen können fehlen. Erstes Problem: {err}"),
    ("de", "error.allFailed", "Zu keiner der {total} Kacheln kam eine brauchbare Antwort ({failed} Fehler). Erstes Problem: {err}"),
]
