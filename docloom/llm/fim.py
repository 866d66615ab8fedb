"""Fill-in-the-middle rewriting: texts cut at line ends that are found by arithmetic on 64-bit words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import fields_of, keep_columns, ship_package

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
SLICE_BYTES = 4 << 20  # text handled at once, unless one text has more; numpy needs about six bytes for each
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)
_LINE = np.uint64(0x0A0A0A0A0A0A0A0A)
_ONE = np.uint64(1)


def line_ends(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is a line feed. Adding 127 to the low seven bits of a byte never carries over, so
    a byte's top bit stays clear only if the byte equals the line feed."""
    other = words ^ _LINE
    return ~(((other & _LOW) + _LOW) | other | _LOW)


def continuations(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte 10xxxxxx, which goes on with a character of UTF-8."""
    return words & ~(words << _ONE) & _HIGH


class Marks:
    """Marked bytes of a buffer of words, counted per word; ``marks`` holds one word more than the buffer."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each place."""
        word = at >> 3
        below = (_ONE << (at & 7).astype(np.uint64) * np.uint64(8)) - _ONE
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, number: np.ndarray) -> np.ndarray:
        """Place of the marked byte of each number, from 0: its word by search in the running counts, then its bit by
        taking away the marks before it."""
        word = np.searchsorted(self.before, number, "right") - 1
        left, mark = number - self.before[word], self.marks[word]
        for k in range(7):
            mark = np.where(left > k, mark & (mark - _ONE), mark)
        lowest = mark & (~mark + _ONE)
        return word * 8 + (np.bitwise_count(lowest - _ONE) >> 3)


def _cuts(raw: np.ndarray, begins: np.ndarray, draws: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of texts that stand one after the other in ``raw``: number of lines, places of both cuts, characters before the
    first and between them."""
    words = np.zeros((len(raw) >> 3) + 1, np.uint64)
    words.view(np.uint8)[: len(raw)] = raw
    marks = line_ends(words)
    start, end = begins[:-1], begins[1:]
    last = end[end > start] - 1  # a text ends its last line
    np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << (last & 7).astype(np.uint64) * np.uint64(8))
    lines = Marks(marks)
    first = lines.rank(start)
    n = lines.rank(end) - first
    chosen = np.sort(np.stack([d % (n + 1) for d in draws]), 0)
    total = int(lines.before[-1])
    cuts = [np.where(c > 0, lines.select(np.clip(first + c - 1, 0, max(0, total - 1))) + 1, start) if total else start for c in chosen]
    inner = Marks(continuations(words))
    seen = [inner.rank(p) for p in (start, *cuts)]
    chars = [(b - a) - (y - x) for a, b, x, y in ((start, cuts[0], seen[0], seen[1]), (cuts[0], cuts[1], seen[1], seen[2]))]
    return n, *cuts, *chars


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow array of strings and where each text begins (one place more at the end)."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    begins = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), begins


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 100, suffix_first: int = 50, seed: int = 7, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """Documents as prefix, suffix and middle for training on infilling. All columns of ``docs`` but ``text``, then n (lines),
    form, prefix_chars, middle_chars and output, the rewritten text.

    A line is a run of characters up to and with a line feed; what follows the last one is a line too. Four numbers come
    from the SHA-256 of ``seed``, a colon and the key: two choose the lines after which prefix and middle end, the third
    whether the text is rewritten (``rate`` of 100), the fourth the order (``suffix_first`` of 100: "spm", else "psm").
    Empty texts and texts that hold a sentinel stay "plain"; their prefix_chars and middle_chars are null.

    Lines and characters are counted on the UTF-8 bytes, eight at a time, for all texts of a slice together; a text is
    never decoded. A null text is empty, a null key counts as an empty string; rows with equal keys get equal draws.
    Rows are independent: no shuffle, an empty table gives no rows. Input columns named like results are replaced.
    """
    ship_package(docs.sparkSession)
    kept = [c for c in keep_columns(docs, ["n", "form", "prefix_chars", "middle_chars", "output"]) if c != text]
    before, after, within = (s.encode() for s in sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring("__digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    body = F.col("__text")
    taken = (body != "") & ~(body.contains(sentinels[0]) | body.contains(sentinels[1]) | body.contains(sentinels[2]))
    form = F.when(~taken | (drawn[2] % 100 >= rate), "plain").when(drawn[3] % 100 < suffix_first, "spm").otherwise("psm")
    asked = docs.select(F.struct(*kept).alias("__row") if kept else F.lit(None).cast("string").alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__text"), digest.alias("__digest"))
    ready = asked.select("__row", "__text", drawn[0].alias("__h1"), drawn[1].alias("__h2"), form.alias("form"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, begins = _buffer(b.column("__text"))
            i = 0
            while i < len(b):
                j = max(i + 1, int(np.searchsorted(begins, begins[i] + SLICE_BYTES, "right")) - 1)
                raw = data[begins[i] : begins[j]]
                own = begins[i : j + 1] - begins[i]
                some = b.slice(i, j - i)
                n, p, m, prefix, middle = _cuts(raw, own, [some.column(c).to_numpy(zero_copy_only=False) for c in ("__h1", "__h2")])
                whole, forms, out = raw.tobytes(), some.column("form").to_pylist(), []
                for kind, s, x, y, e in zip(forms, own[:-1].tolist(), p.tolist(), m.tolist(), own[1:].tolist(), strict=True):
                    if kind == "plain":
                        out.append(whole[s:e])
                    elif kind == "psm":
                        out.append(b"".join((before, whole[s:x], after, whole[y:e], within, whole[x:y])))
                    else:
                        out.append(b"".join((after, whole[y:e], before, whole[s:x], within, whole[x:y])))
                plain = np.array([f == "plain" for f in forms])
                yield pa.RecordBatch.from_arrays(
                    [some.column("__row"), pa.array(n, pa.int64()), some.column("form"), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(out, pa.binary())],
                    names=["__row", "n", "form", "prefix_chars", "middle_chars", "output"],
                )
                i = j

    schema = f"{fields_of(ready, ['__row'])}, n long, form string, prefix_chars long, middle_chars long, output binary"
    made = ready.mapInArrow(rewrite, schema)
    return made.select(*[F.col("__row").getField(c).alias(c) for c in kept], "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that was rewritten, from the output and its form. No sentinel stands in the text, and none can begin in it and
    end in a sentinel, so each is found once."""
    before, after, within = sentinels

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    middle = F.substring_index(output, within, -1)
    psm = F.concat(between(before, after), middle, between(after, within))
    spm = F.concat(between(before, within), middle, between(after, before))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark, sf):
    out = fill_in_middle(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


ORACLE = r"""
with cut as (
  select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units, sha256('7:' || doc_id) as d from documents),
drawn as (
  select *, len(units) as n, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4 from cut),
placed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as p, greatest(h1 % (n + 1), h2 % (n + 1)) as m,
    case when body = '' or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>') or h3 % 100 >= 100 then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end as form from drawn),
split as (
  select doc_id, n, form, body, array_to_string(units[1:p], '') as a, array_to_string(units[p + 1:m], '') as b, array_to_string(units[m + 1:n], '') as c from placed)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(a) end::bigint as prefix_chars, case when form <> 'plain' then length(b) end::bigint as middle_chars,
  sha256(case form when 'plain' then body when 'psm' then '<P>' || a || '<S>' || c || '<M>' || b else '<S>' || c || '<P>' || a || '<M>' || b end) as output_sha256,
  sha256(body) as restored_sha256
from split
"""

QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op13_fill_in_middle": ORACLE}
