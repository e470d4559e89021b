"""Expressions over object paths and URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_scheme(uri: Column) -> Column:
    """``s3://`` becomes ``s3a://``; any other text is unchanged."""
    return F.regexp_replace(uri, "^s3://", "s3a://")


def remap_prefix(path: Column, source: str, target: str) -> Column:
    """Move ``source`` and everything below it to ``target``; other paths are unchanged."""
    source, target = source.rstrip("/"), target.rstrip("/")
    below = F.concat(F.lit(target), F.substring(path, len(source) + 1, 2**31 - 1))
    return F.when(path.startswith(source + "/"), below).when(path == source, F.lit(target)).otherwise(path)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def strip_suffix(name: Column, suffix: str) -> Column:
    kept = F.substring(name, F.lit(1), F.char_length(name) - F.lit(len(suffix)))
    return F.when(name.endswith(suffix), kept).otherwise(name)


def flatten_name(path: Column, env: str) -> Column:
    """``<env>_<basename>``; two paths with the same basename collide (see ``name_collisions``)."""
    return F.concat_ws("_", F.lit(env), basename(path))


def object_key(env: Column, section: Column, name: Column, folder: str = "ddl/configs") -> Column:
    return F.concat_ws("/", env, F.lit(folder), section, name)


def join_uri(base: Column, suffix: Column) -> Column:
    """Append ``suffix`` with exactly one slash added, and only if ``base`` lacks it."""
    return F.concat(F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/"))), suffix)


def uri_parts(uri: Column) -> Column:
    """Struct of scheme, authority, key (no leading slash, query or fragment) and basename."""
    key = F.regexp_extract(uri, r"^[^:/?#]+://[^/?#]*/*([^?#]*)", 1)
    return F.struct(
        F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)).alias("scheme"),
        F.regexp_extract(uri, r"^[^:/?#]+://([^/?#]*)", 1).alias("authority"),
        key.alias("key"),
        basename(key).alias("basename"),
    )


def canonical_path(path: Column) -> Column:
    """One spelling for paths that name the same object: ``/a``, ``file:/a`` and ``file:///a``, or
    ``s3``, ``s3a`` and ``s3n``."""
    local = F.regexp_replace(path, "^(?:file:)?/+", "/")
    return F.regexp_replace(local, "^s3[an]?://", "s3://")


def relative_key(path: Column, prefix: Column) -> Column:
    """The part of ``path`` below ``prefix``."""
    bare = F.regexp_replace(prefix, "/+$", "")
    return F.substring(path, F.char_length(bare) + F.lit(2), F.char_length(path))


_REGEX_SPECIAL = set(r"\.^$|()[]{}*+?-&~#")


def _quote(text: str) -> str:
    return "".join("\\" + c if c in _REGEX_SPECIAL else c for c in text)


def glob_to_regex(glob: str) -> str:
    """Regular expression for a storage-CLI glob, in which ``*`` also crosses slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = glob[i + 1 : end]
            negated = body[:1] == "!"
            body = body[negated:]
            # keep ranges such as a-z, quote everything else
            quoted = "".join(ch if ch == "-" else _quote(ch) for ch in body)
            out.append(f"[{'^' if negated else ''}{quoted}]")
            i = end
        else:
            out.append(_quote(c))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def any_name_regex(names: list[str]) -> str:
    """Pattern that finds any of the literal ``names`` anywhere in a text."""
    return "|".join(_quote(n) for n in names)
