"""Access-log lines and the pattern sets that count them."""

from __future__ import annotations

# Fixed values of the log format and its two pattern sets.
VERBS = ("GET", "POST", "PUT", "DELETE", "HEAD")
PATHS = (
    "/api/v1/users", "/api/v2/orders", "/api/v3/items", "/static/app.js",
    "/health", "/api/v1/search", "/images/logo.png", "/api/v11/metrics",
)
STATUSES = (200, 200, 200, 201, 301, 404, 500)
AGENTS = (
    "Mozilla/5.0 (X11; Linux x86_64) Gecko/20100101 Firefox/129.0",
    "curl/8.5.0",
    "python-requests/2.31.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36",
)
MATCH_ALL = (
    r"10\.0\.[0-9]+\.[0-9]+ -",
    r"\[[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}",
    r"01/Oct/2026:16:0[0-9]",
    r"\+0000\]",
    r'"(GET|POST|PUT|DELETE|HEAD) /',
    r'HTTP/1\.1" [2-5][0-9]{2}',
    r'[0-9]+ [0-9]+ "-"',
    r'" "[A-Za-z]',
)
SELECTIVE = (
    r"(GET|POST) /api/v[0-9]+/[a-z]+",
    r"Firefox/1[0-9]+",
    r"/api/v[0-9]+/(users|orders)",
    r'" (500|404) ',
    "curl/8",
    "python-requests",
    r'"DELETE /',
    r"/static/app\.js",
)


def pick(key: str, values: tuple) -> str:
    """SQL text: the value at key modulo their number."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE CAST({key} % {len(values)} AS INT) {cases} END"


def line(key: str) -> str:
    """SQL text of a log line that depends on a non-negative integer column alone."""
    parts = [
        "'10.0.'", f"CAST({key} % 2 AS STRING)", "'.'", f"CAST({key} % 251 AS STRING)", "' - - [01/Oct/2026:16:0'", f"CAST({key} % 10 AS STRING)",
        "':00 +0000] \"'", pick(key, VERBS), "' '", pick(f"({key} * 31)", PATHS), "' HTTP/1.1\" '", pick(f"({key} * 17)", STATUSES),
        "' '", f"CAST(120 + {key} * 7919 % 89880 AS STRING)", "' '", f"CAST(1 + {key} % 4000 AS STRING)", "' \"-\" \"'", pick(f"({key} * 13)", AGENTS), "'\"'",
    ]
    return f"concat({', '.join(parts)})"
