"""Paths: comparable forms, parents, ancestors, folder scopes, and titles read from names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def comparable(path: Column) -> Column:
    """``\\`` as ``/``, runs of ``/`` as one, no ``/`` at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/"), "(?<=.)/$", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def ancestors(path: Column) -> Column:
    """All folders above a path, the nearest last."""
    parts = F.split(parent(comparable(path)), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def in_folder(path: Column, folder: str, recursive: bool) -> Column:
    """Whether the path lies in the folder (ASCII letters match in either case), at any depth or directly."""
    prefix = folder.rstrip("/") + "/"
    inside = F.lower(path).startswith(prefix.lower())
    rest = F.substring(path, len(prefix) + 1, 1 << 30)
    return inside if recursive else inside & (F.instr(rest, "/") == 0)


def contains(column: Column, text: str) -> Column:
    return F.lower(column).contains(text.lower())


#: What cameras and scanners put at the beginning and the end of a name.
LEADING = (r"^(?:IMG|DSC[NF]?|DSCN|IMGP|SAM|MVI|MOV|VID|WP|PANO)[-_]?\d+(?:[-_]\d+)*", r"^scan\s*\d*", r"^(?:image|photo|pic|picture|img)\s*\d*", r"^P\d{4,}")
TRAILING = (r"\s+scan\s*\d+$", r"\s+(?:IMG|DSC[NF]?|DSCN)[-_]?\d+$", r"[\s_\-]+\d{1,4}$")


def stem(name: Column) -> Column:
    """A file name without its extension; a dot at the beginning starts none."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def display_title(name: Column) -> Column:
    """A file name without extension, camera ids at either end, a lone number at the end and signs at the edges; null
    if nothing but a number or the word scan is left."""
    t = stem(name)
    for pattern in (*LEADING, *TRAILING):
        t = F.regexp_replace(t, "(?i)" + pattern, "")
    t = F.regexp_replace(F.regexp_replace(t, r"^[\s,.\-_]+", ""), r"[\s,.\-_]+$", "")
    return F.when((t != "") & ~t.rlike(r"(?i)^(\d+|scan)$"), t)


def only_camera_id(name: Column) -> Column:
    """Whether a file name is a camera's or scanner's id and nothing else."""
    known = F.trim(stem(name)).rlike("(?i)" + "|".join(f"(?:{p})" for p in LEADING))
    return known & display_title(name).isNull()


def file_url(path: Column) -> Column:
    """The ``file://`` URL of an absolute path, percent-encoded as paths are."""
    plain = F.replace(F.replace(F.url_encode(F.regexp_replace(path, r"\\", "/")), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.concat(F.when(path.startswith("/"), "file://").otherwise("file:///"), plain)


def relative_folder(path: Column, root: str) -> Column:
    """The folder of a path below ``root``; empty for files directly in it."""
    return F.regexp_replace(F.substring(parent(comparable(path)), len(root.rstrip("/")) + 1, 1 << 30), "^/", "")


def match_form(path: Column) -> Column:
    """The comparable form under which stored paths match; Windows paths (a drive or a backslash) in lower case."""
    t = F.trim(path)
    form = comparable(t)
    return F.when(t.rlike(r"^[A-Za-z]:|\\"), F.lower(form)).otherwise(form)


def covered(folder: Column, scope: Column, recursive: Column) -> Column:
    """Whether a folder is the scope's own, or lies below it if the scope is recursive; blank ones never are."""
    a, b = match_form(folder), match_form(scope)
    return (a != "") & (b != "") & ((a == b) | (recursive & a.startswith(F.concat(b, F.lit("/")))))
