"""URLs: host rewriting, document paths, image links in text, source labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the local host, white space (with that of other scripts), and the three forms of an image link in a text.
LOCAL = r"(?i)^https?://(?:localhost|127\.0\.0\.1|\[::1\])(?=[:/?#]|$)"
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
TAGGED = r"(?i)\[img\](https?://[^\[]+)\[/img\]"
MARKDOWN = rf"(?i)!\[[^\]]*\]\((https?://[^{SPACE})]+)\)"
BARE = rf"""(?i)(https?://[^{SPACE}"'<>]+\.(?:jpg|jpeg|png|gif|webp|avif)(?:\?[^{SPACE}"'<>]*)?)"""

#: Addresses of a thread, and which group is its number. The first that fits counts.
THREADS = [r"(?i)^forum/thread/(\d+)$", r"(?i)^forum/(\d+)/\d+$", r"(?i)^forum/(\d+)$", r"(?i)(?:^|/)thread/(\d+)$"]


def rewrite_localhost(url: Column, scheme: str, host: str) -> Column:
    """Scheme and host replaced where the host is local; port, path, query and fragment stay."""
    return F.when(F.rlike(url, F.lit(LOCAL)), F.regexp_replace(url, LOCAL, f"{scheme}://{host}")).otherwise(url)


def document_path(url: Column) -> Column:
    """Viewer path of a source URL: path part without leading slashes, cut at ``#``, decoded, then cut at ``?``;
    thread addresses become ``thread_N.json``, in any case of letters; '' for nothing or a bare fragment."""
    url = F.coalesce(url, F.lit(""))
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?"
    # An absolute URL has its query apart from the path; in other texts a bare ? is cut after decoding.
    rest = F.when(F.rlike(url, F.lit(scheme)), F.regexp_replace(F.regexp_replace(url, scheme, ""), r"(?s)[?#].*$", "")).otherwise(url)
    rest = F.regexp_replace(F.regexp_replace(rest, r"^/+", ""), r"(?s)#.*$", "")
    # Only the encoded form of + is decoded; a bare one stays. Broken escapes leave the text as it is.
    decoded = F.coalesce(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), rest)
    path = F.regexp_replace(decoded, r"(?s)\?.*$", "")
    out = path
    for pattern in reversed(THREADS):
        found = F.regexp_extract(path, pattern, 1)
        out = F.when(found != "", F.concat(F.lit("thread_"), found, F.lit(".json"))).otherwise(out)
    return F.when(F.rlike(path, F.lit(r"(?i)^thread_\d+$")), F.concat(path, F.lit(".json"))).otherwise(out)


def image_urls(text: Column) -> Column:
    """Image links (http or https) of a text: tagged ones, then Markdown ones, then bare ones with an image suffix;
    trimmed, each once."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (TAGGED, MARKDOWN, BARE)])
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.regexp_replace(u, rf"^[{SPACE}]+|[{SPACE}]+$", "")), lambda u: u != ""))


def source_label(title: Column, section: Column, url: Column) -> Column:
    """The section of a forum post (by its title, for lack of a section), else a Markdown link."""
    forum = F.contains(F.coalesce(section, F.lit("")), F.lit("Post by")) | F.contains(title, F.lit("Thread"))
    return F.when(forum, F.coalesce(F.nullif(section, F.lit("")), title)).otherwise(F.concat(F.lit("["), title, F.lit("]("), url, F.lit(")")))
