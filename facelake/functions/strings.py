"""Names, paths and request parameters as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from facelake.functions.sampling import let

EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tiff")


def extension(name: Column) -> Column:
    """Lower-cased text behind the last dot, empty without a dot."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def allowed_file(name: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    return F.coalesce(name.contains(".") & extension(name).isin(*extensions), F.lit(False))


@lru_cache(maxsize=1)
def ascii_forms() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves of each character in ASCII: characters and their one letter,
    and those that leave several."""
    one, several = {}, {}
    for code in (c for c in range(128, 0x30000) if not 0xD800 <= c < 0xE000):
        left = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if left:
            (one if len(left) == 1 else several)[chr(code)] = left
    return "".join(one), "".join(one.values()), several


def to_ascii(text: Column) -> Column:
    """Letters without their accents, ligatures and the like as letters; what has no such form goes."""
    ones, letters, several = ascii_forms()
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    def spelled(plain: Column) -> Column:
        # looked up once for each character that is no ASCII, not for each place of the text
        odd = F.array_distinct(F.split(F.regexp_replace(plain, r"[\x00-\x7F]+", ""), ""))
        pairs = F.filter(F.transform(odd, lambda c: F.struct(c.alias("c"), F.try_element_at(table, c).alias("to"))), lambda p: p["to"].isNotNull())
        return F.aggregate(pairs, plain, lambda t, p: F.replace(t, p["c"], p["to"]))

    def ascii_of(plain: Column) -> Column:
        return F.when(plain.rlike(r"[^\x00-\x7F]"), F.regexp_replace(spelled(plain), r"[^\x00-\x7F]+", "")).otherwise(plain)

    return F.when(text.rlike(r"[^\x00-\x7F]"), let(F.translate(text, ones, letters), ascii_of)).otherwise(text)


def secure_filename(name: Column) -> Column:
    """A name safe as a file name: ASCII letters, digits, dot, dash and underscore, no leading or trailing dots."""
    spaced = F.translate(to_ascii(name), "/\\", "  ")
    joined = F.regexp_replace(F.trim(spaced), r"\s+", "_")
    return F.btrim(F.regexp_replace(joined, r"[^A-Za-z0-9_.-]+", ""), F.lit("._"))


def safe_name(name: str) -> str:
    """secure_filename of one name, on the driver."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().replace("/", " ").replace("\\", " ")
    joined = re.sub(r"\s+", "_", plain.strip(" "))
    return re.sub(r"^[._]+|[._]+$", "", re.sub(r"[^A-Za-z0-9_.-]", "", joined))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def person_id(path: Column, base: Column | str) -> Column:
    """The first component below base; outside of base the parent folder's name."""
    base = F.lit(base) if isinstance(base, str) else base
    prefix = F.when(F.endswith(base, F.lit("/")), base).otherwise(F.concat(base, F.lit("/")))
    parts = F.split(path, "/")
    below = F.split(F.substring(path, F.length(prefix) + 1, F.length(path)), "/")[0]
    return F.when(F.startswith(path, prefix), below).otherwise(F.try_element_at(parts, F.lit(-2)))


def flag(param: Column, default: bool) -> Column:
    """Whether a parameter says true, its default where it is missing."""
    return F.coalesce(F.lower(param) == "true", F.lit(default))


def integer(param: Column, default: int) -> Column:
    """A parameter as an integer: the default where it is missing, null where it is none."""
    return F.when(param.isNull(), F.lit(default)).otherwise(param.try_cast("int"))


def percent(similarity: Column) -> Column:
    return F.printf(F.lit("%.2f%%"), similarity * 100)
