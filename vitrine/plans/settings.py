"""Settings: defaults, coercion of single values, secrets, and which credentials hold."""

from __future__ import annotations

import base64
import hashlib
import re
from urllib.parse import unquote, urlsplit

from vitrine.functions.stem import LANGUAGES

#: Keys, their defaults, and the limits of numbers.
DEFAULTS = {
    "engine": "elasticsearch", "es_url": "", "es_username": "", "es_password": "", "es_api_key": "", "es_timeout": 5, "search_timeout": 1.5, "index_name": "", "analysis_language": "brazilian",
    "batch_size": 50, "auto_indexing_enabled": False, "auto_check_frequency": "hourly", "divergence_threshold_pct": 5, "max_retries": 3, "alert_email_enabled": False, "alert_email_address": "",
    "alert_dashboard_enabled": True, "route_item_lists": True, "route_facets": True, "facet_max_terms": 300, "log_retention_days": 30, "menu_location": "other", "search_typo_tolerance": False,
    "search_prefix": True, "last_index_run_ts": 0, "last_health_check_ts": 0,
}
LIMITS = {"es_timeout": (1, 60), "search_timeout": (0.5, 10.0), "batch_size": (1, 1000), "divergence_threshold_pct": (0, 100), "max_retries": (0, 10), "log_retention_days": (1, 365), "facet_max_terms": (10, 1000)}
CHOICES = {"auto_check_frequency": ("tim_15min", "tim_30min", "hourly", "tim_6hours", "daily"), "menu_location": ("root", "other")}
SECRET_KEYS = ("es_password", "es_api_key")
MASK = "__set__"
_INLINE = re.compile(r"(https?://)(.*)@([^@/]+(?::\d+)?)(/.*)?", re.I)


def default_index_name(home: str) -> str:
    return f"tnc_{hashlib.md5(home.encode()).hexdigest()[:8]}_items"


def _number(value: object, kind: type) -> float:
    try:
        return kind(float(value))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return kind(0)


def coerce(key: str, value: object, home: str = "") -> object:
    """A value as its key wants it: within limits, of its choices, else its default."""
    default = DEFAULTS[key]
    if key in LIMITS:
        low, high = LIMITS[key]
        n = round(_number(value, float), 1) if isinstance(default, float) else _number(value, int)
        return type(default)(min(high, max(low, n)))
    if isinstance(default, bool):
        return bool(value) and value not in ("0", "false")
    if isinstance(default, int):
        return int(max(0, _number(value, int)))
    text = value.strip() if isinstance(value, str) else ""
    if key in CHOICES:
        return text if text in CHOICES[key] else default
    if key == "engine":
        return "elasticsearch" if text.lower() in ("elasticsearch", "opensearch", "es", "index") else "sql"
    if key == "es_url":
        parts = urlsplit(text)
        return text if parts.scheme.lower() in ("http", "https") and parts.hostname else ""
    if key == "index_name":
        return re.sub(r"[^a-z0-9_-]", "", text.lower()) or default_index_name(home)
    if key == "analysis_language":
        return text.lower() if text.lower() in LANGUAGES else default
    return re.sub(r"<[^>]*>", "", text)


def update(current: dict, changes: dict, home: str = "") -> dict:
    """Known keys only; a masked secret keeps its value."""
    out = dict(DEFAULTS) | current
    for k, v in changes.items():
        if k in DEFAULTS and not (k in SECRET_KEYS and v == MASK):
            out[k] = coerce(k, v, home)
    return out


def masked(settings: dict) -> dict:
    return {k: MASK if k in SECRET_KEYS and v else v for k, v in settings.items()}


def inline_credentials(url: str) -> tuple[str, str, str]:
    """The bare URL, user and password; the user part ends at the last @ before the host."""
    m = _INLINE.fullmatch(url)
    if not m:
        return url, "", ""
    user, _, password = m[2].partition(":")
    return m[1] + m[3] + (m[4] or ""), unquote(user), unquote(password)


def auth(settings: dict) -> tuple[str, str, str]:
    """Method, user and header: an API key before a user before credentials in the URL."""
    if key := settings.get("es_api_key"):
        return "api_key", "", f"ApiKey {key}"
    user, password, method = settings.get("es_username", ""), settings.get("es_password", ""), "basic_auth"
    if not user and not password:
        _, user, password = inline_credentials(settings.get("es_url", ""))
        method = "basic_auth_inline"
    if not user and not password:
        return "none", "", ""
    return method, user, "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()
