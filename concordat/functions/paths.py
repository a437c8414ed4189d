"""Path, permission and display functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hidden(path: Column) -> Column:
    """Whether a segment of the path begins with a dot."""
    return path.rlike(r"(^|/)\.")


def parent_dir(path: Column) -> Column:
    """Text before the last slash, else empty."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestor_dirs(path: Column) -> Column:
    """Directories above the path, deepest first."""
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.reverse(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))


def normalize(path: Column) -> Column:
    """Backslashes to slashes, no slash at the end except for the root."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "(?<=.)/+$", "")


def to_native(path: Column) -> Column:
    """Identity on the platforms Spark runs on."""
    return path


def drive_id(mount: Column) -> Column:
    """Letters and digits of a mount name; ``drive`` if none."""
    clean = F.regexp_replace(mount, "[^A-Za-z0-9]", "")
    return F.when(clean == "", F.lit("drive")).otherwise(clean)


#: Permission flags, from owner read to others execute.
FLAGS = ["owner_read", "owner_write", "owner_exec", "group_read", "group_write", "group_exec", "others_read", "others_write", "others_exec"]


def permissions_text(flags: Column) -> Column:
    """Struct of nine booleans to three octal digits."""
    bit = lambda name, weight: F.when(flags[name], F.lit(weight)).otherwise(F.lit(0))
    return F.concat(*[sum((bit(n, w) for n, w in zip(FLAGS[i : i + 3], (4, 2, 1), strict=True)), F.lit(0)).cast("string") for i in (0, 3, 6)])


def permissions_flags(text: Column) -> Column:
    """The last three octal digits to nine booleans; a bad digit is 0, a text of under three characters all false."""
    digit = lambda i: F.when((F.char_length(text) >= 3) & F.substring(text, F.char_length(text) - 2 + i, F.lit(1)).rlike("^[0-7]$"), F.try_element_at(F.array(*[F.lit(d) for d in range(8)]), F.substring(text, F.char_length(text) - 2 + i, F.lit(1)).try_cast("int") + 1)).otherwise(F.lit(0))
    return F.struct(*[(F.coalesce(digit(i // 3), F.lit(0)).bitwiseAND(F.lit((4, 2, 1)[i % 3])) != 0).alias(n) for i, n in enumerate(FLAGS)])


def format_bytes(n: Column) -> Column:
    """B, KB and MB with one decimal, GB with two; base 1024, ties to the even digit."""
    k = 1024
    return (
        F.when(n < k, F.format_string("%d B", n))
        .when(n < k**2, F.format_string("%.1f KB", F.bround(n / k, 1)))
        .when(n < k**3, F.format_string("%.1f MB", F.bround(n / k**2, 1)))
        .otherwise(F.format_string("%.2f GB", F.bround(n / k**3, 2)))
    )
