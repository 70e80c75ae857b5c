"""Text quality statistics of documents, and the mails whose own body is not prose."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import lines
from tidemark.llm.batches import sliced
from tidemark.llm.mail import own_body

#: Characters of a piece, but for longer lines or words; a longer text is counted piece by piece, which changes no count.
PIECE = 16_384
#: Pieces of a text whose counts are merged first.
FAN_IN = 16
#: A text of more pieces is spread over tasks before it is counted.
SPREAD = 64
#: Pieces that a batch of such texts holds.
ROWS = 256
#: A frequent-word list beyond this many words is refused: it goes to every task.
MOST_WORDS = 100_000

_BLOCK = ("chars", "words", "common", "signs", "kana", "stops", "lines")
_SUMS = ("chars", "words", "letters", "symbols", "common")
_LINE = ("lines", "ended", "broken", "head", "tail")


def common_set(words: DataFrame, word: str = "word") -> frozenset[str]:
    """Distinct frequent words, trimmed and in lower case; at most MOST_WORDS of them."""
    found = words.select(F.lower(F.trim(word)).alias("w")).where("w is not null and w <> ''").distinct().limit(MOST_WORDS + 1).collect()
    if len(found) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} frequent words")
    return frozenset(r["w"] for r in found)


def _counted(docs: DataFrame, ident: str, text: str, names: list[str], prepare: Callable, cut: Callable, count: Callable) -> DataFrame:
    """(ident, piece, *names): the counts of each piece of each text that `prepare` gives something for.

    `cut` gives (piece, context) of a text, `count` of such a pair the counts. Texts of up to
    SPREAD pieces are counted where they are; the pieces of longer ones travel by (ident,
    piece) first, so that one huge text is counted by many tasks. Of the others only counts
    travel, along the same way: one scan, one exchange.
    """
    rows = docs.select(F.col(ident), F.col(text))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{ident}` {kind}, piece long, rest string, context string, " + ", ".join(f"{n} long" for n in names)
    columns = [ident, "piece", "rest", "context", *names]

    def batch_of(ids: pa.Array, made: list[tuple]) -> pa.RecordBatch:
        at, numbers, rests, contexts, counts = zip(*made) if made else ((), (), (), (), ())
        values = [pa.array(c, pa.int64()) for c in zip(*counts)] if made else [pa.array([], pa.int64())] * len(names)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(numbers, pa.int64()), pa.array(rests, pa.string()), pa.array(contexts, pa.string()), *values], columns)

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (None,) * len(names)
        for batch in sliced(batches):
            made: list[tuple] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = prepare(t)
                if own is None:
                    continue
                parts = cut(own)
                if len(parts) <= SPREAD:
                    made += [(i, n, None, None, count(*part)) for n, part in enumerate(parts)]
                    continue
                for first in range(0, len(parts), ROWS):
                    yield batch_of(batch.column(0), [(i, first + n, *part, none) for n, part in enumerate(parts[first : first + ROWS])])
            yield batch_of(batch.column(0), made)

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.column(2)
            if rest.null_count < len(rest):
                found = [(None if r is None else count(r, c)) for r, c in zip(rest.to_pylist(), batch.column(3).to_pylist())]
                values = [pa.array([b if f is None else f[k] for f, b in zip(found, batch.column(4 + k).to_pylist())], pa.int64()) for k in range(len(names))]
            else:
                values = batch.columns[4:]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], [ident, "piece", *names])

    spread = rows.mapInArrow(here, schema).repartition(ident, "piece")
    return spread.mapInArrow(there, f"`{ident}` {kind}, piece long, " + ", ".join(f"{n} long" for n in names))


# --- prose or not -------------------------------------------------------------


def _body_counts(docs: DataFrame, ident: str, text: str, common: frozenset[str], piece: int) -> DataFrame:
    """One row of counts for each piece of each document's own body."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    names = ["chars", "junk", "broken", *(f"h_{b}" for b in _BLOCK), *(f"t_{b}" for b in _BLOCK)]
    return _counted(docs, ident, text, names, own_body, lambda t: lines.pieces(t, piece), lambda part, after: lines.count(part, shared.value, after).row())


def _idle(block: Column) -> Column:
    """lines.idle as a column expression over an array of a paragraph's counts."""

    def of(b: Column) -> Column:
        chars, words, common, signs, kana, stops, rows = (F.element_at(b, k + 1) for k in range(len(_BLOCK)))
        spoken = (
            (common >= lines.LEAST_COMMON * words)
            | ((common > 0) & (words < lines.SHORT))
            | ((stops > 0) & (3 * stops <= words) & (words <= lines.LONGEST_SENTENCE * stops) & (words > 3 * rows))
        )
        asian = (signs >= lines.FEW_SIGNS) & (signs >= words)
        idle = F.when(asian, kana < lines.LEAST_KANA * signs).otherwise((words >= lines.FEW_WORDS) & ~spoken)
        return F.when(idle, chars).otherwise(0)

    # bound once, as the counts may be a long expression
    return F.element_at(F.transform(F.array(block), of), 1)


def _joined(a: Column, b: Column) -> Column:
    """The paragraph that two open ends make together."""
    return F.zip_with(a, b, lambda x, y: x + y)


def _merged(a: Column, b: Column) -> Column:
    """Counts of two pieces that follow each other: the paragraph that lies over the cut is closed or stays open."""
    across = F.when(a["broken"] > 0, _joined(a["tail"], b["head"])).otherwise(_joined(a["head"], b["head"]))
    both = (a["broken"] > 0) & (b["broken"] > 0)
    return F.struct(
        (a["chars"] + b["chars"]).alias("chars"),
        (a["junk"] + b["junk"] + F.when(both, _idle(_joined(a["tail"], b["head"]))).otherwise(0)).alias("junk"),
        F.greatest(a["broken"], b["broken"]).alias("broken"),
        F.when(a["broken"] > 0, a["head"]).otherwise(across).alias("head"),
        F.when(b["broken"] > 0, b["tail"]).when(a["broken"] > 0, across).otherwise(b["tail"]).alias("tail"),
    )


def _fold(parts: DataFrame, by: list[str], merge: Callable[[Column, Column], Column]) -> DataFrame:
    """The counts of each group's pieces in their order, merged into one."""
    row = F.array_sort(F.collect_list(F.struct("piece", "c")))
    each = parts.groupBy(*by).agg(row.alias("_p"), F.min("piece").alias("piece"))
    first = F.element_at("_p", 1)["c"]
    return each.select(*by, "piece", F.aggregate(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), first, lambda acc, x: merge(acc, x["c"])).alias("c"))


def _merged_tree(parts: DataFrame, ident: str, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """(ident, c) of (ident, piece, c): a text's counts, FAN_IN neighbouring pieces merged first, then the rest."""
    few = parts.withColumn("_few", F.floor(F.col("piece") / FAN_IN))
    return _fold(_fold(few, [ident, "_few"], merge), [ident], merge)


def prose_shares(docs: DataFrame, words: DataFrame, ident: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """(ident, n_chars, n_idle, idle_share): of each mail's own body, the characters, those in list items,
    table rows or junk, and their share.

    A null or blank text, or one without own body, has no row; line ends don't count as
    characters. `ident` is unique; two rows with the same are merged. A body longer than
    `piece` is counted in pieces of whole lines, whose number changes nothing. Within a
    piece, paragraphs that end are judged and leave two sums; those open at its ends leave
    their counts, which the merge joins over the cut. Only counts are shuffled, and the
    pieces of huge texts.
    """
    counts = _body_counts(docs, ident, text, common_set(words), piece)
    ends = [F.array(*[f"{e}_{n}" for n in _BLOCK]).alias(name) for e, name in (("h", "head"), ("t", "tail"))]
    whole = _merged_tree(counts.select(ident, "piece", F.struct("chars", "junk", "broken", *ends).alias("c")), ident, _merged)
    idle = F.col("c.junk") + _idle(F.col("c.head")) + _idle(F.col("c.tail"))
    return whole.select(ident, F.col("c.chars").alias("n_chars"), idle.alias("n_idle")).withColumn("idle_share", F.when(F.col("n_chars") > 0, F.col("n_idle") / F.col("n_chars")).otherwise(0.0))


def not_prose(docs: DataFrame, words: DataFrame, ident: str = "doc_id", text: str = "text", above: float = 0.5) -> DataFrame:
    """(ident): the mails of whose own body more than `above` is list items, table rows or junk."""
    return prose_shares(docs, words, ident, text).where(F.col("idle_share") > above).select(ident)


# --- statistics of the whole text -----------------------------------------------


_ENDS = frozenset(".!?…。！？:;\"”»'")
_SYMBOL = re.compile(r"[^\w\s]|_")


def _sign(row: str) -> int:
    """How a line, or a part of one, ends: 0 with nothing in it, 2 with a sign that ends sentences, else 1."""
    row = row.rstrip()
    return 0 if not row else 2 if row[-1] in _ENDS else 1


def _piece_counts(part: str, common: frozenset[str]) -> list[int]:
    """Sums over a piece, and what its lines say: those closed in it, and how the lines open at its ends end here."""
    words = part.split()
    hits = sum(w.strip(".,;:!?\"'()").lower() in common for w in words)
    ends = [_sign(row) for row in part.split("\n")]
    inner = ends[1:-1]
    broken = len(ends) > 1
    return [len(part), len(words), sum(map(len, words)), len(_SYMBOL.findall(part)), hits, sum(e > 0 for e in inner), inner.count(2), int(broken), ends[0], ends[-1] if broken else 0]


def _merged_sums(a: Column, b: Column) -> Column:
    """Sums of two pieces that follow each other; the line that lies over the cut ends as its last part with something in it."""
    over = F.when(b["head"] > 0, b["head"]).otherwise(F.when(a["broken"] > 0, a["tail"]).otherwise(a["head"]))
    closed = (a["broken"] > 0) & (b["broken"] > 0)
    return F.struct(
        *[(a[n] + b[n]).alias(n) for n in _SUMS],
        (a["lines"] + b["lines"] + F.when(closed & (over > 0), 1).otherwise(0)).alias("lines"),
        (a["ended"] + b["ended"] + F.when(closed & (over == 2), 1).otherwise(0)).alias("ended"),
        F.greatest(a["broken"], b["broken"]).alias("broken"),
        F.when(a["broken"] > 0, a["head"]).otherwise(over).alias("head"),
        F.when(b["broken"] > 0, b["tail"]).when(a["broken"] > 0, over).otherwise(b["tail"]).alias("tail"),
    )


def statistics(docs: DataFrame, words: DataFrame, ident: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """(ident, n_chars, n_words, mean_word_length, symbol_share, n_lines, ended_share, common_share, prose):
    statistics of each whole text and the outcome of the rules over them.

    Words are separated by white space; a symbol is neither letter, digit nor white space;
    only lines with something in them count, by how they end. A null text counts as empty;
    an empty one has zeros and is no prose. Shares over nothing are 0. `prose`: mean word
    length from 2 to 12, symbols at most a quarter, a twentieth of frequent words at least.
    A text longer than `piece` is counted in pieces of whole words, whose number changes
    nothing: sums add up, and the merge closes the line that lies over a cut.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_set(words))
    counts = _counted(docs, ident, text, [*_SUMS, *_LINE], lambda t: t or "", lambda t: lines.word_pieces(t, piece), lambda part, _: _piece_counts(part, shared.value))
    whole = _merged_tree(counts.select(ident, "piece", F.struct(*_SUMS, *_LINE).alias("c")), ident, _merged_sums).select(ident, "c.*")
    open_ends = (F.col("head"), F.col("tail"))
    total = whole.withColumns(
        {"lines": F.col("lines") + sum((e > 0).cast("long") for e in open_ends), "ended": F.col("ended") + sum((e == 2).cast("long") for e in open_ends)}
    )

    def share(a: str, b: str) -> Column:
        # in whole millionths, a half rounded up, by numbers that are exact
        return F.when(F.col(b) > 0, F.expr(f"(2000000 * `{a}` + `{b}`) div (2 * `{b}`)") / 1_000_000).otherwise(0.0)

    out = total.select(
        ident,
        F.col("chars").alias("n_chars"),
        F.col("words").alias("n_words"),
        share("letters", "words").alias("mean_word_length"),
        share("symbols", "chars").alias("symbol_share"),
        F.col("lines").alias("n_lines"),
        share("ended", "lines").alias("ended_share"),
        share("common", "words").alias("common_share"),
    )
    return out.withColumn("prose", F.col("mean_word_length").between(2, 12) & (F.col("symbol_share") <= 0.25) & (F.col("common_share") >= 0.05))
