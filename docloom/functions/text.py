"""Text expressions. All of them stay inside the JVM."""

from __future__ import annotations

import functools
import html.entities
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# A character that is never assigned, used to mark cut points inside one text.
MARK = "\uffff"

# The nine characters that a file name may not hold.
FORBIDDEN_IN_FILE_NAME = r'[\\/:*?"<>|]+'


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind, not only ASCII blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalise_cell(c: Column) -> Column:
    """Null to empty, anything to stripped text."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def normalise_key(c: Column) -> Column:
    """Like ``normalise_cell``, and drop the ``.0`` that a numeric sheet column leaves on whole keys.

    Whole numbers that a floating-point column would print with an exponent (from 1e7) are written out."""
    number = c.try_cast("double")
    whole = F.typeof(c).isin("double", "float") & (number == F.floor(number)) & (F.abs(number) < 1e18)
    return F.when(whole, number.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(normalise_cell(c), r"\.0$", ""))


def safe_file_name(c: Column) -> Column:
    """Each run of forbidden characters becomes one underscore."""
    return F.regexp_replace(c, FORBIDDEN_IN_FILE_NAME, "_")


def keyed_path(no: Column, name: Column, suffix: str = ".txt") -> Column:
    return F.concat_ws("/", no, F.concat(safe_file_name(name), F.lit(suffix)))


def name_matches(c: Column, pattern: str) -> Column:
    """Anchored at the start only."""
    return c.rlike(f"^(?:{pattern})")


def local_name(qname: Column) -> Column:
    """Text after the last colon; null becomes empty."""
    return F.coalesce(F.substring_index(qname, ":", -1), F.lit(""))


def anchor_id(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.translate(name, ":. ", "___"))


def function_name(key: Column, prefix: str = "test") -> Column:
    return F.concat(F.lit(prefix + "_"), F.translate(key, ".", "_"))


def prefixed_value(c: Column, prefix: str) -> Column:
    """Value of the last line that starts with ``prefix``, or empty when there is none."""
    lines = F.filter(F.split(c, "\n"), lambda line: line.startswith(prefix))
    last = F.try_element_at(lines, F.lit(-1))
    return F.coalesce(F.substr(last, F.lit(len(prefix) + 1)), F.lit(""))


def shorten(c: Column, limit: int) -> Column:
    """Texts above ``limit`` keep ``limit - 3`` characters and get three dots."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def snippet(c: Column) -> Column:
    """One-line snippet of at most 100 characters."""
    return F.translate(shorten(c, 100), "\n\r", " ")


def squeeze(c: Column) -> Column:
    """Runs of newline, tab and blank become one blank; ends stripped."""
    return strip(F.regexp_replace(c, r"[\n\t ]+", " "))


def one_line(c: Column) -> Column:
    """Newline and carriage return to one blank each, so that a term can match across a line break."""
    return F.translate(c, "\n\r", "  ")


def matching_lines(text: Column, needle: Column, ignore_case: bool = False) -> Column:
    """Lines that hold ``needle``, stripped and joined with one blank."""
    if ignore_case:
        hit = lambda line: F.contains(F.lower(line), F.lower(needle))
    else:
        hit = lambda line: F.contains(line, needle)
    return F.array_join(F.transform(F.filter(F.split(text, "\n"), hit), strip), " ")


def newlines(c: Column) -> Column:
    """Number of newline characters."""
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def line_at(text: Column, needle: Column | str, base: Column | int = 1) -> Column:
    """Line number of the first ``needle`` in ``text``, counted from ``base``; null if absent."""
    start = F.instr(text, needle)
    return F.when(start > 0, F.lit(base) + newlines(F.substr(text, F.lit(1), start - 1)))


def only_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\n]+", "")


def blank_blocks(text: Column, pattern: str) -> Column:
    """Remove every match of ``pattern`` but keep the newlines in it, so line numbers stay right."""
    return F.array_join(
        F.zip_with(
            F.split(text, pattern),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda kept, gone: F.concat(kept, F.coalesce(only_newlines(gone), F.lit(""))),
        ),
        "",
    )


def cut(text: Column, pattern: str) -> Column:
    """Split ``text`` into pieces: even positions lie between matches, odd positions are the matches.

    One pass of the pattern; no position arithmetic, so it is linear in the text length.
    """
    return F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit("")), pattern, f"{MARK}$0{MARK}"), MARK)


def match_lines(pieces: Column) -> Column:
    """Line number (from 1) of each match in the output of :func:`cut`, in order.

    The text is reduced to its newlines plus one mark per match; splitting that skeleton by newline
    gives the number of matches that start on each line.
    """
    skeleton = F.array_join(
        F.transform(
            pieces,
            lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(MARK), only_newlines(p))).otherwise(only_newlines(p)),
        ),
        "",
    )
    return F.flatten(
        F.transform(F.split(skeleton, "\n"), lambda marks, i: F.array_repeat(i + 1, F.length(marks)))
    )


@functools.lru_cache(maxsize=1)
def _entities() -> tuple[str, str, str]:
    """Pattern of an entity, and the names and characters of the HTML table of the Python library, each list in one text.

    Old names also count without a semicolon; the longest such name wins."""
    known = html.entities.html5
    bare = sorted((n for n in known if not n.endswith(";")), key=len, reverse=True)
    pattern = rf"&(?:#[0-9]{{1,7}};?|#[xX][0-9A-Fa-f]{{1,6}};?|[A-Za-z][A-Za-z0-9]*;|(?:{'|'.join(bare)}))"
    return pattern, "\n".join(known), "\x01".join(known.values())


def _character(code: Column) -> Column:
    """The character with a code point; 128 to 159 mean code page 1252, as in browsers; null for numbers that are none."""
    old = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    table = F.create_map(*[F.lit(x) for kv in old.items() for x in kv])
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    plain = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.coalesce(F.when(code.between(128, 159), F.try_element_at(table, code.cast("int"))), plain)


def unescape(c: Column) -> Column:
    """Character entities to characters, in one pass; unknown names stay as written, but a longer name that begins with an
    old one is read as that and the rest."""
    entity, names, characters = _entities()
    named = F.map_from_arrays(F.split(F.lit(names), "\n"), F.split(F.lit(characters), "\x01"))

    def decoded(p: Column) -> Column:
        body = F.regexp_extract(p, "^&#?[xX]?([0-9A-Za-z]+);?$", 1)
        number = F.when(p.rlike("^&#[xX]"), F.conv(body, 16, 10)).otherwise(body).try_cast("bigint")
        whole = F.try_element_at(named, F.substring(p, 2, 40))
        old = F.regexp_extract(p, "^" + entity.replace("[A-Za-z][A-Za-z0-9]*;|", ""), 0)
        begun = F.concat(F.try_element_at(named, F.substring(old, 2, 40)), F.substr(p, F.length(old) + 1))
        found = F.when(p.startswith("&#"), _character(number)).otherwise(F.coalesce(whole, F.when(F.length(old) > 1, begun)))
        return F.coalesce(found, p)

    joined = F.array_join(F.transform(cut(c, entity), lambda p, i: F.when(i % 2 == 1, decoded(p)).otherwise(p)), "")
    return F.when(c.rlike(entity), joined).otherwise(c)


def line_ends(c: Column) -> Column:
    """``\\r\\n`` and ``\\r`` as ``\\n``; plain replaces, which cost less than a pattern."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; unchanged when it lies elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def relabel(c: Column, labels: dict[str, str]) -> Column:
    """Look ``c`` up in a fixed label table; values without a label stay as they are."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


@functools.lru_cache(maxsize=1)
def wide_class() -> str:
    """Regex class of the characters shown two columns wide (East Asian widths F, W and A).

    Derived from the Unicode tables of the running Python, so nothing is listed by hand.
    """
    runs: list[list[int]] = []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        if unicodedata.east_asian_width(chr(code)) in "FWA":
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def display_width(c: Column) -> Column:
    """Columns a text takes on a terminal: wide characters count two."""
    narrow_only = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x7F]+", ""), wide_class(), "")
    plain = F.regexp_replace(c, r"[^\x00-\x7F]+", "")
    return F.length(c) * 2 - F.length(plain) - F.length(narrow_only)


def pad_display(c: Column, width: Column | int) -> Column:
    """Pad on the right with blanks up to ``width`` display columns."""
    missing = F.greatest(F.lit(0), F.lit(width) - display_width(c)).cast("int")
    return F.concat(c, F.repeat(F.lit(" "), missing))
