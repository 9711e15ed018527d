"""Parameters of all stages in one place; every value that changes a result is here."""

# Fixed values, as the reproduced behaviour needs them.
CLEAN = {
    "min_words": 50,
    "placeholder_phrases": ("content to follow", "coming soon", "tbd"),
    "placeholder_max_words": 200,
    "boilerplate_tags": ("header", "footer", "nav", "aside"),
    "boilerplate_names": ("cookie", "alert-bar", "promo", "breadcrumb", "utility-bar", "sidebar", "related-links"),
    "disclaimer_prefixes": ("CONFIDENTIALITY NOTICE",),
    "running_band": 3,
    "running_page_share": 0.5,
}
DEDUPE = {"shingle_words": 5, "jaccard": 0.90}
FORMAT_RANK = {"pdf": 0, "html": 1, "docx": 2, "md": 3, "txt": 4}
FIXED_CHUNKS = {"size": 800, "overlap": 150, "backoff": 50}
STRUCTURE_CHUNKS = {"max_chars": 1200, "min_chars": 200, "table_max_chars": 2000, "backoff": 200}
BM25 = {"k1": 1.5, "b": 0.75, "floor": 0.25}
RETRIEVAL = {"candidates": 50, "rrf_k": 60, "rerank": 30, "top_k": 10}
EVAL_K = (5, 10)
TAU = 0.10
MAX_ROUNDS = 3
#: Sides of joins are broadcast up to this many rows, counted at run time; beyond it they are shuffled.
BROADCAST_ROWS = 200_000
