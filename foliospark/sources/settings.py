"""Settings as a plain dictionary, with the values that the pipeline starts from."""

from __future__ import annotations

# The limits and settings in force without a file.
DEFAULTS = {
    "ocr": {"engine": "fixture", "rpm": 2000, "rpd": 10000, "retries": 8, "timeout_s": 180, "dpi": 300, "backoff_base_s": 4.0, "backoff_cap_s": 120.0},
    "pipeline": {"max_pdf_size_mb": 100, "batch_size": 10, "upload_retention_hours": 24, "output_retention_days": 7, "history": 10},
}


def settings(text: str | None = None) -> dict[str, dict]:
    """DEFAULTS with the values of a file of sections and ``key: value`` lines."""
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    section: dict = {}
    for line in (text or "").splitlines():
        line = line.split("#")[0].rstrip()
        if not line.strip():
            continue
        key, _, value = line.strip().partition(":")
        if not line[0].isspace():
            section = out.setdefault(key, {})
            continue
        value = value.strip().strip("\"'")
        for kind in (int, float):
            try:
                value = kind(value)
                break
            except ValueError:
                pass
        section[key] = value
    return out


def client_settings(config: dict) -> dict:
    return {"max_pdf_size_mb": config["pipeline"]["max_pdf_size_mb"]}
