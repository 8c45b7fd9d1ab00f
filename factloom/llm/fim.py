"""Fill-in-the-middle documents: units of a text as a compressed boundary set, two cuts by select, and the way back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, code_points

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Offsets that share a container, and the most that a container keeps as a sorted array: beyond, a bitmap of 8 KiB is smaller.
SPAN, ARRAY_MOST = 1 << 16, 4096
#: Set bits of each byte.
ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


class BoundarySet:
    """Ascending offsets in containers of SPAN values: array, bitmap or runs, whichever takes fewest bytes.

    before[i] counts the members ahead of container i, so select() looks up the container by its cumulative
    cardinality and then the place inside it; no offset outside that container is touched.
    """

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(high)) + 1, [len(offsets)]]) if len(offsets) else np.zeros(1, np.int64)
        self.before = cuts
        self.keys = high[cuts[:-1]]
        self.containers = [self._container(offsets[a:b] & (SPAN - 1)) for a, b in zip(cuts[:-1], cuts[1:])]

    def __len__(self) -> int:
        return int(self.before[-1])

    @staticmethod
    def _container(low: np.ndarray) -> tuple[str, tuple[np.ndarray, ...]]:
        first = np.concatenate([[0], np.flatnonzero(np.diff(low) != 1) + 1])
        array_bytes, run_bytes = (2 * len(low) if len(low) <= ARRAY_MOST else SPAN // 8), 4 * len(first)
        if run_bytes < array_bytes:
            return "runs", (low[first].astype(np.uint16), first)
        if len(low) <= ARRAY_MOST:
            return "array", (low.astype(np.uint16),)
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        packed = np.packbits(bits, bitorder="little")
        words = ONES[packed].reshape(-1, 8).sum(1)
        return "bitmap", (packed, np.cumsum(words) - words)

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, "right")) - 1
        kind, parts = self.containers[at]
        local = k - int(self.before[at])
        if kind == "array":
            low = int(parts[0][local])
        elif kind == "runs":
            run = int(np.searchsorted(parts[1], local, "right")) - 1
            low = int(parts[0][run]) + local - int(parts[1][run])
        else:
            word = int(np.searchsorted(parts[1], local, "right")) - 1
            bits = np.unpackbits(parts[0][8 * word : 8 * word + 8], bitorder="little")
            low = 64 * word + int(np.flatnonzero(bits)[local - int(parts[1][word])])
        return (int(self.keys[at]) << 16) + low


def _ends(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units end (offsets after their last code point), the texts' own ends aside: whether a unit ends after each code point."""
    if unit == "char":
        return np.ones(len(points), bool)
    if unit == "line":
        return points == 10
    white = (points == 32) | ((points >= 9) & (points <= 13))
    return ~white & np.append(white[1:], True)


def _cuts(text: pa.Array, first: pa.Array, second: pa.Array, unit: str) -> pa.Array:
    points, offsets = code_points(text)
    ends = np.flatnonzero(_ends(points, unit)) + 1
    if unit == "token":  # the last word of a text ends with it, whatever the next text begins with
        last = offsets[1:][np.diff(offsets) > 0]
        word = points[last - 1]
        ends = np.union1d(ends, last[~((word == 32) | ((word >= 9) & (word <= 13)))])
    low, high = np.searchsorted(ends, offsets[:-1], "right"), np.searchsorted(ends, offsets[1:], "right")
    h1, h2 = first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)
    out = np.zeros((3, len(text)), np.int64)
    for i, (a, b, start, stop) in enumerate(zip(low.tolist(), high.tolist(), offsets[:-1].tolist(), offsets[1:].tolist())):
        own = ends[a:b] - start
        if stop > start and (not len(own) or own[-1] != stop - start):  # what follows the last end is a unit too
            own = np.append(own, stop - start)
        bounds = BoundarySet(np.concatenate([[0], own]).astype(np.int64))
        n = len(bounds) - 1
        x, y = int(h1[i]) % (n + 1), int(h2[i]) % (n + 1)
        out[:, i] = n, bounds.select(min(x, y)), bounds.select(max(x, y))
    return pa.StructArray.from_arrays([pa.array(column) for column in out], ["n", "first", "second"])


CUTS = StructType([StructField(name, LongType()) for name in ("n", "first", "second")])


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from; a plain output is the text."""
    at = lambda mark: F.locate(mark, output)
    between = lambda a, b: F.substring(output, at(a) + F.lit(len(a)), at(b) - at(a) - F.lit(len(a)))
    rest = F.substring(output, at(MIDDLE) + F.lit(len(MIDDLE)), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), rest, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), rest, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, seed: int = 42, moved: int = 50, suffix_first: int = 80, unit: str = "token") -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output), a row for each row of docs.

    A text is cut after two of its n units (token: white space and the word behind it; char; line), chosen by the hash
    of seed and doc_id; moved percent of the texts are rearranged, suffix_first percent of those with the suffix in
    front (spm). Forms and cuts depend on doc_id and text alone, so lost tasks run again alike; nothing is shuffled.

    A null text is an empty one; empty texts and texts that hold one of the marks stay plain. A null doc_id hashes as
    an empty one; repeated rows stay and come out alike; other columns are left out; an empty table gives no rows.
    """
    if unit not in ("token", "char", "line"):
        raise ValueError(f"unknown unit: {unit}")
    bounded_batches(docs.sparkSession)
    cut = F.arrow_udf(lambda text, first, second: _cuts(text, first, second, unit), CUTS)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h[2] % 100 >= moved)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    found = texts.select("doc_id", "text", form.alias("form"), cut(text, h[0], h[1]).alias("cut"))
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    chars = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    return found.select(
        "doc_id", "text", F.col("cut.n").alias("n"), "form", chars(first).alias("prefix_chars"), chars(second - first).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text).alias("output"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the sha256 of the output and of the text rebuilt from it."""
    made = transform(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def digest_sql() -> str:
    """digest() over documents, as SQL."""
    hash_part = "('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), {}, 8))::BIGINT AS h{}"
    white = r"\x20\x09-\x0D"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[{white}]*[^{white}]+|[{white}]+') AS u, {', '.join(hash_part.format(8 * i + 1, i + 1) for i in range(4))}
  FROM documents
), c AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS x, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:x], '') AS a, array_to_string(u[x + 1:y], '') AS m, array_to_string(u[y + 1:n], '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || a || '<M>' || m ELSE t END) AS output_sha256,
  sha256(a || m || s) AS restored_sha256
FROM p"""
