"""Parameters of the knowledge-base jobs.

Every folder, limit and template is a parameter; the defaults below are the
fixed values the original application used, kept so results match it.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (must equal the original application's for identical output).
# Prompt pieces, in the order they are concatenated.
SYSTEM_PROMPT = (
    '<s>[INST]You are a helpful, respectful and honest assistant. '
    'If you are unsure about an answer, truthfully say "I don\'t know".'
)
PLAIN_INSTRUCTION = "Please answer the user question.[/INST]</s>"
CONTEXT_INSTRUCTION_HEAD = "Answer the user's question based on the folloing information:\n "
CONTEXT_INSTRUCTION_TAIL = "[/INST]</s>"
PLAIN_QUESTION_HEAD = " \n [INST] "      # between instruction and question, no context
CONTEXT_QUESTION_HEAD = " \n[INST] "     # between instruction and question, with context
QUESTION_TAIL = " [/INST]"
CITATION_HEAD = "\n\n For additional info see: "
CITATION_LINK_LABEL = "[Reference 1]"
ECHO_OFFSET = 2                          # answer = output[len(prompt) - 2:]
# Request defaults of the scoring endpoint.
DEFAULT_MAX_NEW_TOKENS = 50
DEFAULT_TEMPERATURE = 0.0
DEFAULT_REPETITION_PENALTY = 1.0
DEFAULT_NUM_BEAMS = 1
DEFAULT_TOP_P = 1.0
DEFAULT_TOP_K = 0
# Chat form domains and defaults.
TEMPERATURE_MIN = 0.01
TEMPERATURE_MAX = 1.0
TEMPERATURE_UI_DEFAULT = 0.5
TOKEN_CHOICES = (50, 100, 250, 500, 1000)
TOKEN_UI_DEFAULT = 100
# Index and retrieval.
VECTOR_DIM = 768
MAX_EMBED_TOKENS = 256
TOP_K_DOT = 5          # dot-product backend asks for 5, uses the first
TOP_K_L2 = 1           # squared-L2 backend asks for 1
ID_HEX_CHARS = 10      # id = first 10 hex chars of sha256(path)
FALLBACK_ID_CHARS = 50  # id = first 50 characters of the text when no path
CLASSIFICATION = "public"
BASE_PATH = "/data/kb"        # any folder; a parameter everywhere
# Fetch retries.
MAX_RETRIES = 5
RETRY_DELAY_SECONDS = 2
# Links the crawler follows or keeps.
PAGE_SUFFIX = ".html"
SITEMAP_SUFFIX = ".xml"
# HTML named character references decoded by the text extractor (HTML standard
# names; "&amp;" is always applied last so "&amp;lt;" becomes "&lt;").
HTML_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
    ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&bull;", "•"), ("&trade;", "™"),
    ("&euro;", "€"), ("&deg;", "°"), ("&times;", "×"),
)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class KbParams:
    """One object carries every knob of the jobs (no globals, no fixed folder)."""

    base_path: str = BASE_PATH
    dim: int = VECTOR_DIM
    max_embed_tokens: int = MAX_EMBED_TOKENS
    top_k: int = TOP_K_DOT
    id_chars: int = ID_HEX_CHARS
    fallback_id_chars: int = FALLBACK_ID_CHARS
    classification: str = CLASSIFICATION
    echo_offset: int = ECHO_OFFSET
    content_tag: str | None = None   # None = whole page (the original wrote the whole page text)
    # An exact top-k search: bytes of vectors in a block of either side, pivots at most.
    block_bytes: int = 16 << 20
    max_cells: int = 1024


DEFAULT = KbParams()
