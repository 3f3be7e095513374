"""Path functions over slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by extension, pinned so that results do not depend on the host.
MIME_TYPES = {
    ".avif": "image/avif",
    ".css": "text/css; charset=utf-8",
    ".gif": "image/gif",
    ".htm": "text/html; charset=utf-8",
    ".html": "text/html; charset=utf-8",
    ".jpeg": "image/jpeg",
    ".jpg": "image/jpeg",
    ".js": "text/javascript; charset=utf-8",
    ".json": "application/json",
    ".md": "text/markdown; charset=utf-8",
    ".mjs": "text/javascript; charset=utf-8",
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".svg": "image/svg+xml",
    ".txt": "text/plain; charset=utf-8",
    ".wasm": "application/wasm",
    ".webp": "image/webp",
    ".xml": "text/xml; charset=utf-8",
}
DEFAULT_MIME_TYPE = "application/octet-stream"


def extension(path: Column) -> Column:
    """Lower-cased suffix from the last dot of the last component, dot included; '' without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def mime_type(ext: Column) -> Column:
    """Media type of a lower-cased extension."""
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit(DEFAULT_MIME_TYPE))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normalized(path: Column) -> Column:
    """path without empty and '.' components, '..' resolved where something precedes it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(kept: Column, part: Column) -> Column:
        can_drop = (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
        dropped = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        rooted = F.startswith(path, F.lit("/"))
        return F.when(part != "..", F.concat(kept, F.array(part))).when((F.size(kept) > 0) & can_drop, dropped).when(rooted, kept).otherwise(F.concat(kept, F.array(part)))

    none = F.array().cast("array<string>")
    out = F.when(F.contains(path, F.lit("..")), F.aggregate(parts, none, step)).otherwise(parts)
    lead = F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise("")
    joined = F.concat(lead, F.array_join(out, "/"))
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def relative_path(path: Column, root: Column) -> Column:
    """path seen from root, both absolute and normalized; '.' is root itself."""
    at, base = F.split(F.when(path == "/", F.lit("")).otherwise(path), "/"), F.split(F.when(root == "/", F.lit("")).otherwise(root), "/")
    inside = F.startswith(path, F.concat(F.when(root == "/", F.lit("")).otherwise(root), F.lit("/")))
    short = F.substr(path, F.when(root == "/", F.lit(2)).otherwise(F.length(root) + 2))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.size(base)), lambda n: F.slice(at, 1, n) == F.slice(base, 1, n)))
    ups = F.array_repeat(F.lit(".."), (F.size(base) - shared).cast("int"))
    far = F.array_join(F.concat(ups, F.slice(at, shared + 1, F.size(at))), "/")
    return F.when(path == root, F.lit(".")).when(inside, short).otherwise(far)


def is_local(relative: Column) -> Column:
    """Whether a normalized relative path stays below its root."""
    return (relative != "..") & ~F.startswith(relative, F.lit("../")) & ~F.startswith(relative, F.lit("/"))


def below_skipped(rel_path: Column, skip: frozenset[str]) -> Column:
    """Whether any directory above the path's last component is skipped: exact base names, at any depth."""
    parts = F.split(rel_path, "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(above, lambda p: p.isin(*sorted(skip))) if skip else F.lit(False)


def first_skipped(rel_path: Column, skip: frozenset[str]) -> Column:
    """The topmost skipped directory above the path, from the root; null where none is."""
    parts = F.split(rel_path, "/")
    at = F.array_min(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: (n < F.size(parts)) & F.get(parts, n - 1).isin(*sorted(skip))))
    return F.array_join(F.slice(parts, F.lit(1), at), "/")


def walk_key(rel_path: Column) -> Column:
    """Sorting by this gives the order of a lexical depth-first walk."""
    return F.split(rel_path, "/")


def valid_repo_name(name: Column) -> Column:
    return F.coalesce(~name.isin("", ".", "..") & ~F.rlike(name, F.lit(r"[/\\]")), F.lit(False))
