"""Classification of fetch outcomes: kind, status, crash and retry classes, sites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloam.functions.text import url_host

# Error phrases of a crashed browser (lower case).
CRASH_PHRASES = (
    "browser has been closed",
    "browser disconnected",
    "target closed",
    "connection refused",
    "protocol error",
    "session closed",
    "page crashed",
    "context closed",
    "playwright._impl._errors",
)

# Words of errors that are worth another attempt, per kind of fetch.
RETRY_WORDS = {
    "html": ("timeout", "connection", "network", "temporary"),
    "pdf": ("timeout", "connection", "network"),
}

# Substrings of the hosts of scientific publishers.
SCIENTIFIC_HOSTS = (
    "sciencedirect.com", "elsevier.com", "springer.com", "nature.com", "wiley.com",
    "tandfonline.com", "sagepub.com", "oxford", "cambridge.org", "plos.org",
    "frontiersin.org", "mdpi.com", "hindawi.com", "biomedcentral.com", "bmj.com",
    "pubmed", "ncbi.nlm.nih.gov", "researchgate.net", "academia.edu", "arxiv.org",
    "doi.org", "jstor.org", "ieee.org", "acm.org",
)


def _quoted(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


# N3
def is_pdf_url(url: Column) -> Column:
    """URL ends in ``.pdf`` (any case, slashes behind it allowed); a query string defeats it."""
    return url.rlike(r"(?i)\.pdf/*\z")


# N4
def is_pdf_content_type(header: Column) -> Column:
    return F.contains(F.lower(header), F.lit("application/pdf"))


# N5
def detect_kind(header: Column, url: Column) -> Column:
    """The header decides for PDF, the URL is the fallback; another header vetoes nothing."""
    pdf = F.coalesce(is_pdf_content_type(header), F.lit(False)) | F.coalesce(is_pdf_url(url), F.lit(False))
    return F.when(pdf, F.lit("pdf")).otherwise(F.lit("html"))


# N6
def result_content_type(kind: Column, success: Column) -> Column:
    return F.when(kind == "pdf", F.lit("pdf")).when(success, F.lit("spa")).otherwise(F.lit("html"))


# N7
def classify_status(success: Column, error: Column) -> Column:
    timed_out = F.coalesce(F.contains(F.lower(error), F.lit("timeout")), F.lit(False))
    return F.when(timed_out, F.lit("timeout")).when(success, F.lit("success")).otherwise(F.lit("error"))


# N8
def is_browser_crash(error: Column) -> Column:
    return F.coalesce(F.lower(error).rlike(_quoted(CRASH_PHRASES)), F.lit(False))


# N9
def is_retryable(error: Column, kind: Column) -> Column:
    low = F.lower(error)
    return F.coalesce(
        F.when(kind == "pdf", low.rlike(_quoted(RETRY_WORDS["pdf"])))
        .otherwise(low.rlike(_quoted(RETRY_WORDS["html"]))), F.lit(False))


# F11
def is_scientific_site(url: Column) -> Column:
    """Host contains one of the publisher marks; no host means no."""
    return F.coalesce(url_host(url).rlike(_quoted(SCIENTIFIC_HOSTS)), F.lit(False))
