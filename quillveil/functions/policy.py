"""Small decisions as expressions: kinds of files, which requests may go out, which key is used, what may be downloaded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types of files, hosts that serve models, path of the usage counter, messages of failed scans.
MIME = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pdf": "application/pdf",
    "txt": "text/plain;charset=utf-8",
    "csv": "text/csv;charset=utf-8",
}
MODEL_HOSTS = ("huggingface.co", "hf.co", "jsdelivr.net")
BEACON_PATH = "/_vercel/insights"
LOW_QUALITY, UNSAFE = ("SCAN_LOW_CONFIDENCE",), ("SCAN_UNMAPPABLE_PII", "SCAN_SELFVERIFY_FAILED")
READABLE = ("pdf", "xlsx", "csv", "docx", "txt")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "([^.]*)$", 1))


def mime_of(path: Column) -> Column:
    out = F
    for kind, mime in MIME.items():
        out = out.when(extension(path) == kind, mime)
    return out.otherwise("application/octet-stream")


def refusal(path: Column) -> Column:
    """Why a file can't be read: LEGACY_XLS_UNSUPPORTED, UNSUPPORTED, or null."""
    return F.when(extension(path) == "xls", "LEGACY_XLS_UNSUPPORTED").when(~extension(path).isin(*READABLE), "UNSUPPORTED")


def _resolved(url: Column, origin: Column) -> tuple[Column, Column, Column]:
    """Scheme, origin and path of a URL that may be relative to an origin."""
    absolute = url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    whole = F.when(absolute, url).when(url.startswith("//"), F.concat(F.regexp_extract(origin, "^([A-Za-z][^:]*:)", 1), url)).otherwise(F.concat(origin, F.when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url))))
    scheme = F.lower(F.regexp_extract(whole, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    own = F.regexp_replace(F.lower(F.regexp_extract(whole, "^([A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#]*)", 1)), "^(http://[^/]*):80$|^(https://[^/]*):443$", "$1$2")
    return scheme, F.regexp_replace(own, "//[^/@]*@", "//"), F.regexp_extract(whole, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def model_host(host: Column) -> Column:
    out = F.lit(False)
    for h in MODEL_HOSTS:
        out = out | (host == h) | host.endswith(f".{h}")
    return out


def usage_beacon(url: Column, origin: Column) -> Column:
    _, own, path = _resolved(url, origin)
    return (own == F.lower(origin)) & path.startswith(BEACON_PATH)


def allowed_request(url: Column, origin: Column) -> Column:
    """In-memory URLs, the page's own origin and model hosts; what isn't a URL isn't allowed."""
    scheme, own, _ = _resolved(url, origin)
    host = F.regexp_replace(F.regexp_extract(own, "://([^/]*)$", 1), ":[0-9]*$", "")
    return F.coalesce(scheme.isin("blob", "data") | (own != "") & ((own == F.lower(origin)) | model_host(host)), F.lit(False))


def active_key(uploaded: Column, session: Column) -> Column:
    """An uploaded key goes before the session's."""
    return F.coalesce(uploaded, session)


def uploaded_after(uploaded: Column, new_document: Column) -> Column:
    """A new document's result drops the uploaded key."""
    return F.when(~new_document, uploaded)


def download_gate(redacted: Column, manual: Column, n_keys: Column, source: Column, ner: Column, upgrading: Column) -> Column:
    """hidden, retry, pending or ready."""
    waits = ~manual & (source == "file")
    return F.when(~redacted | (manual & (n_keys == 0)), "hidden").when(waits & (ner == "error"), "retry").when(waits & (ner.isin("loading", "idle") | upgrading), "pending").otherwise("ready")


def scan_notice(message: Column) -> Column:
    """lowQuality, unsafe, or null."""
    holds = lambda marks: F.greatest(*(F.contains(message, F.lit(m)) for m in marks)) if len(marks) > 1 else F.contains(message, F.lit(marks[0]))
    return F.when(holds(LOW_QUALITY), "lowQuality").when(holds(UNSAFE), "unsafe")
