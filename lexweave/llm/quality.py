"""Quality by an interpolated modified Kneser-Ney n-gram model of trusted text (operator 7).

Symbols are the bytes of UTF-8, so no letters are folded together, and a gram with its language fits one long:
the language's hash above, the bytes below. The model is a set of tables as large as the grams of the trusted text; it is
never broadcast. Documents meet it by joins: each chunk of documents asks for its different grams once,
the answers come back to the chunk, and its documents are scored there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, steps, texts_of, written

ORDER = 5
SYMBOL_BITS = 8
#: A language's hash has the bits above those of the longest gram.
LANG_SHIFT = 40
POOL = "*"
#: Languages with a model of their own, the most frequent ones; there are fewer languages in the world.
LANGS_MOST = 10_000
#: Text that a chunk of documents holds, about, and symbols that are coded at a time.
CHUNK_BYTES = 32 << 20
_BLOCK = 1 << 20
#: Grams that a task sums before it passes them on.
_SUM_MOST = 1 << 20
#: Quantiles of the held-out trusted documents between which a document stays.
LOW, HIGH = 0.005, 0.97
#: So many held-out documents of a language weigh as much as those of all languages together.
HELD_EVEN = 200
#: Bits of the filter by which most documents without trust stay out of the join with the trusted ids.
FILTER_BITS = 1 << 25
FILTER_HASHES = 4


def lang_key(lang: str) -> int:
    """23 bits of the language's hash, above the gram's."""
    return (zlib.crc32(lang.encode("utf-8", "replace")) & ((1 << 23) - 1)) << LANG_SHIFT


def symbols(text: str) -> np.ndarray:
    """The bytes of a text after ORDER - 1 zeros and before one, which stand for its edges."""
    own = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return np.concatenate([np.zeros(ORDER - 1, np.int64), own, [0]])


def gram_codes(s: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Code of the gram that ends at each symbol from the first full one on."""
    n = len(s) - order + 1
    code = np.zeros(n, dtype=np.int64)
    for k in range(order):
        code = (code << SYMBOL_BITS) | s[k : k + n]
    return code


def text_codes(text: str) -> Iterator[np.ndarray]:
    """Codes of the grams of a whole text, in blocks."""
    s = symbols(text)
    for at in range(0, len(s) - ORDER + 1, _BLOCK):
        yield gram_codes(s[at : at + _BLOCK + ORDER - 1])


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, key, n) of all grams of the highest order, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([np.zeros(0, np.int64), *counts]), len(keys)).astype(np.int64)

        def rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], names=["key", "n"])

        for batch in steps(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch, "text"), strict=True):
                for codes in text_codes(text):
                    keys, n = np.unique(codes, return_counts=True)
                    held.append(keys | lang_key(lang))
                    counts.append(n)
                    size += len(keys)
                if size > _SUM_MOST:
                    keys, n = summed()
                    if len(keys) > _SUM_MOST // 2:
                        yield from rows(keys, n)
                        keys, n = keys[:0], n[:0]
                    held, counts, size = [keys], [n], len(keys)
        yield from rows(*summed())

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(POOL)).alias("lang"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _low(key: Column, size: int) -> Column:
    """The gram of `size` symbols that ends a longer one, with the language."""
    return key.bitwiseAND(F.lit(-(1 << LANG_SHIFT) | ((1 << (SYMBOL_BITS * size)) - 1)))


def _context(key: Column) -> Column:
    """All symbols of a gram but the last, with the language."""
    lang = key.bitwiseAND(F.lit(-(1 << LANG_SHIFT)))
    return lang.bitwiseOR(F.shiftright(key.bitwiseAND(F.lit((1 << LANG_SHIFT) - 1)), SYMBOL_BITS))


def kneser_ney(grams: DataFrame, order: int = ORDER) -> dict[int, DataFrame]:
    """For each size the table (key, p, ctx, gamma): interpolated probability of each gram in its context.

    Counts of a lower order are the numbers of different symbols before the gram. Each order
    has three discounts a language from its counts of counts (Chen and Goodman, 1999). An order's
    table joins its context sums, then the table of the order below, all dealt by hash of the gram.
    gamma is the weight that a context leaves to shorter ones.
    """
    counted = {order: written(grams.select("key", "n"), f"grams-{order}")}
    for k in range(order - 1, 0, -1):
        counted[k] = written(counted[k + 1].groupBy(_low(F.col("key"), k).alias("key")).agg(F.count("*").alias("n")), f"grams-{k}")
    lang = F.shiftright("key", LANG_SHIFT).alias("lang")
    out: dict[int, DataFrame] = {}
    for k in range(1, order + 1):
        t = counted[k].select(lang, "key", "n", _context(F.col("key")).alias("ctx"))
        d = t.groupBy("lang").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        raw = [i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")) for i in (1, 2, 3)]
        d = d.select("lang", *[F.greatest(F.lit(0.05), F.least(F.lit(i * 0.95), F.coalesce(r, F.lit(i * 0.5)))).alias(f"d{i}") for i, r in enumerate(raw, 1)])
        # One row a language, at most LANGS_MOST of them and the pool.
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(F.broadcast(d), "lang").select("key", "n", "ctx", off.alias("off"))
        sums = t.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("off").alias("mass"))
        own, gamma = (F.col("n") - F.col("off")) / F.col("total"), F.col("mass") / F.col("total")
        t = t.join(sums.hint("merge"), "ctx").select("key", "ctx", own.alias("own"), gamma.alias("gamma"))
        if k == 1:
            t = t.select("key", (F.col("own") + F.col("gamma") / (1 << SYMBOL_BITS)).alias("p"), "ctx", "gamma")
        else:
            low = out[k - 1].select(F.col("key").alias("low"), F.col("p").alias("q"))
            t = t.withColumn("low", _low(F.col("key"), k - 1)).join(low.hint("merge"), "low").select("key", (F.col("own") + F.col("gamma") * F.col("q")).alias("p"), "ctx", "gamma")
        out[k] = written(t, f"kneser-ney-{k}")
    for table in counted.values():
        discard(table)
    return out


def gram_scores(keys: DataFrame, model: dict[int, DataFrame], order: int = ORDER) -> DataFrame:
    """(key, logp) for the different grams `key`: of a gram that the model lacks, by its context's weight and the next shorter gram."""
    seen = keys.join(model[order].select("key", "p").hint("merge"), "key", "left")
    seen = written(seen, f"asked-{order}")
    weights = model[order].select("ctx", "gamma").distinct()
    gone = seen.where(F.col("p").isNull()).select("key", _context(F.col("key")).alias("ctx"), _low(F.col("key"), order - 1).alias("low"))
    gone = gone.join(weights.hint("merge"), "ctx", "left").select("key", "low", F.coalesce(F.log("gamma"), F.lit(0.0)).alias("more"))
    if order == 1:
        rest = gone.select("key", (F.col("more") - F.log(F.lit(float(1 << SYMBOL_BITS)))).alias("logp"))
    else:
        below = gram_scores(gone.select(F.col("low").alias("key")).distinct(), model, order - 1)
        rest = gone.join(below.select(F.col("key").alias("low"), "logp").hint("merge"), "low").select("key", (F.col("more") + F.col("logp")).alias("logp"))
    out = written(seen.where(F.col("p").isNotNull()).select("key", F.log("p").alias("logp")).unionByName(rest), f"scores-{order}")
    discard(seen)
    return out


def _slots(c: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(c, F.lit(i)), F.lit(FILTER_BITS)) for i in range(FILTER_HASHES)]


def trusted_documents(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang and text of the documents whose id is in `ids`.

    A filter of FILTER_BITS bits, built by sums and broadcast, keeps out most others before their texts, deflated, are
    dealt by id; the join with the ids themselves decides.
    """
    own = ids.select(F.col(id_col).cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    slot = F.explode(F.array(*_slots(F.col("doc_id"))))
    words = own.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(31)).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 5, dtype=np.uint32)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in steps(batches, 4096):
            keep = np.ones(batch.num_rows, dtype=bool)
            for i in range(FILTER_HASHES):
                at = batch.column(f"h{i}").to_numpy()
                keep &= (table[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) > 0
            for part in steps(iter([batch.filter(pa.array(keep))])):
                packed = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts_of(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(packed, pa.binary())], names=["doc_id", "lang", "text"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = [zlib.decompress(x).decode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(texts, pa.string())], names=["doc_id", "lang", "text"])

    key = F.col(id_col).cast("long")
    rows = docs.where(key.isNotNull() & F.col(text_col).isNotNull()).select(key.alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(_slots(key))])
    picked = rows.mapInArrow(pick, "doc_id long, lang string, text binary")
    return picked.join(own.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(unpack, "doc_id long, lang string, text string")


def _sorted_grams(texts: Iterator[tuple[int, str]]) -> np.ndarray:
    """The different grams of (language key, text), in order."""
    keys, held, size = np.zeros(0, np.int64), [], 0
    for lang, text in texts:
        for codes in text_codes(text) if text else ():
            held.append(codes | lang)
            size += len(codes)
            if size > _SUM_MOST:
                keys, held, size = _different([keys, *held]), [], 0
    return _different([keys, *held])


def _different(held: list[np.ndarray]) -> np.ndarray:
    keys = np.sort(np.concatenate(held))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def perplexities(docs: DataFrame, model: dict[int, DataFrame], langs: set[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_symbols, perplexity of every whole text; languages outside `langs` go by the pool.

    First every task gives its different grams, whose scores come from joins with the model's tables. Then the
    documents of a task are packed into chunks of about CHUNK_BYTES. Chunks are dealt once and used
    twice: to ask for the scores of their grams, and, with the answers, to score their documents.
    """
    spark = docs.sparkSession
    known, trained = spark.sparkContext.broadcast(frozenset(langs)), bool(model)

    def keyed(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch, "text"), strict=True):
            yield lang_key(lang if lang in known.value else POOL), text

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in steps(batches, 4096):
            held.append(_sorted_grams(keyed(batch)))
            size += len(held[-1])
            if size > _SUM_MOST:
                held, size = [_different(held)], 0
                if len(held[0]) > _SUM_MOST // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held.pop())], names=["key"])
                size = sum(map(len, held))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(_different(held))], names=["key"])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, n, part = 0, 0, TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "body"])

        for batch in steps(batches):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= CHUNK_BYTES:
                yield close()
                held, size, n = [], 0, n + 1
        if held:
            yield close()

    def opened(body: bytes) -> Iterator[pa.RecordBatch]:
        return steps(iter(pa.ipc.open_stream(body)))

    def asked(body: bytes) -> np.ndarray:
        return _sorted_grams(x for batch in opened(body) for x in keyed(batch))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            block, keys = batch.column("block")[0].as_py(), asked(batch.column("body")[0].as_py())
            for at in range(0, len(keys), 1 << 16):
                own = keys[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(np.arange(at, at + len(own), dtype=np.int32)), pa.array(own)], names=["block", "i", "key"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The answers of a task as one row for each chunk: places as differences, and scores, both deflated."""
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["i"], rows["block"]))]
            edge = np.concatenate([[0], np.flatnonzero(np.diff(rows["block"])) + 1, [len(rows)]])
            parts = [rows[a:b] for a, b in zip(edge, edge[1:], strict=False)]
            columns = [pa.array([zlib.compress(x.tobytes(), 1) for x in own], pa.binary()) for own in ([np.diff(x["i"], prepend=np.int32(0)) for x in parts], [x["logp"].copy() for x in parts])]
            return pa.RecordBatch.from_arrays([pa.array([x["block"][0] for x in parts], pa.int64()), *columns], names=["block", "places", "scores"])

        for batch in batches:
            own = np.empty(batch.num_rows, dtype=[("block", np.int64), ("i", np.int32), ("logp", np.float32)])
            for c in own.dtype.names:
                own[c] = batch.column(c).to_numpy()
            held.append(own)
            size += len(own)
            if size > 2 * _SUM_MOST:
                yield close()
                held, size = [], 0
        if size:
            yield close()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        places = [np.cumsum(np.frombuffer(zlib.decompress(x), np.int32), dtype=np.int32) for x in right.column("places").to_pylist()]
        logp = np.zeros(sum(map(len, places)))
        for at, x in zip(places, right.column("scores").to_pylist(), strict=True):
            logp[at] = np.frombuffer(zlib.decompress(x), np.float32)
        out: dict[str, list] = {"doc_id": [], "lang": [], "n_symbols": [], "perplexity": []}
        for body in left.column("body").to_pylist():
            keys = asked(body) if trained else np.zeros(0, np.int64)
            if len(keys) != len(logp):
                raise ValueError("the answers are not those to the chunk's own grams")
            for batch in opened(body):
                out["doc_id"] += batch.column("doc_id").to_pylist()
                out["lang"] += batch.column("lang").to_pylist()
                for key, text in keyed(batch):
                    total, n = 0.0, 0
                    for codes in text_codes(text) if text and trained else ():
                        total += float(logp[np.searchsorted(keys, codes | key)].sum())
                        n += len(codes)
                    out["n_symbols"].append(len(text.encode("utf-8", "replace")))
                    out["perplexity"].append(float(np.exp(-total / n)) if n else None)
        kinds = [("doc_id", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("perplexity", pa.float64())]
        return pa.table({name: pa.array(out[name], kind) for name, kind in kinds})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    dealt = rows.mapInArrow(chunk, "block long, body binary").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    if trained:
        scores = gram_scores(rows.select("lang", "text").mapInArrow(grams, "key long").distinct(), model)
        asks = dealt.mapInArrow(ask, "block long, i int, key long")
        answers = asks.join(scores.hint("merge"), "key").select("block", "i", F.col("logp").cast("float").alias("logp")).mapInArrow(gather, "block long, places binary, scores binary")
    else:
        answers = spark.createDataFrame([], "block long, places binary, scores binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, lang string, n_symbols long, perplexity double")


def held_out(id_col: str) -> Column:
    """True for the fifth of the ids on which thresholds are set; the model is trained on the rest."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def thresholds(checked: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """cut_lang, low, high: the quantiles of each language's perplexities in (lang, perplexity), by one rule at every size.

    A language has its own median. How far its quantiles lie from that, in logarithms, is the mean of what its own n documents
    say, with weight n, and of what those of all languages say about theirs, with weight HELD_EVEN: the tail of a few
    documents is no more than its extremes. One row a language; the tail of all is one row.
    """
    logs = checked.where(F.col("perplexity") > 0).select("lang", F.log("perplexity").alias("x"))
    middle = logs.groupBy(F.col("lang").alias("cut_lang")).agg(F.percentile_approx("x", 0.5, 10_000).alias("m"), F.count("*").alias("n"))
    apart = logs.join(F.broadcast(middle), F.col("lang") == F.col("cut_lang")).withColumn("r", F.col("x") - F.col("m"))
    edges = F.percentile_approx("r", [low, high], 10_000).alias("e")
    shared = apart.agg(edges).first()["e"] or [0.0, 0.0]
    own = F.col("n") / (F.col("n") + HELD_EVEN)
    at = lambda i: F.exp(F.col("m") + own * F.col("e")[i] + (1 - own) * F.lit(shared[i]))
    return apart.groupBy("cut_lang", "m", "n").agg(edges).select("cut_lang", at(0).alias("low"), at(1).alias("high"))


def score_quality(docs: DataFrame, trusted: DataFrame, low: float = LOW, high: float = HIGH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, low, high, keep for every whole text.

    The model is trained on the documents whose id is in `trusted`, but for the fifth of held_out(); per language, and
    pooled for documents whose language has no trusted text (or comes after the LANGS_MOST most frequent). keep is true
    where the perplexity lies between the language's quantiles over the held-out trusted documents (thresholds() says how
    few of them are made up for). Null text is empty and
    is not kept; null lang goes by the pool; without trusted text perplexity is null and all is kept. Rows with
    the same id are scored each for itself, an empty table gives no row, other columns are not read.
    """
    fit = trusted_documents(docs, trusted.where(~held_out(id_col)), id_col, text_col, lang_col)
    common = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang")).join(trusted.where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    langs = {r["lang"] for r in common.where(F.col("lang").isNotNull()).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS_MOST).collect()}
    counted = written(count_grams(fit), "grams")
    model: dict[int, DataFrame] = {}
    if not counted.isEmpty():
        mapped = F.coalesce(F.col(lang_col).isin(sorted(langs)), F.lit(False))
        own = F.shiftright("key", LANG_SHIFT).isin(sorted(lang_key(x) >> LANG_SHIFT for x in langs))
        grams = counted.where(own)
        if not docs.where(~mapped).isEmpty():
            pool = F.col("key").bitwiseAND(F.lit((1 << LANG_SHIFT) - 1)).bitwiseOR(F.lit(lang_key(POOL)))
            grams = grams.unionByName(counted.groupBy(pool.alias("key")).agg(F.sum("n").alias("n")))
        model = kneser_ney(grams)
    scored = written(perplexities(docs, model, langs, id_col, text_col, lang_col), "perplexity")
    discard(counted)
    sure = trusted.where(held_out(id_col)).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    checked = scored.where(held_out("doc_id")).join(sure.hint("shuffle_hash"), "doc_id", "left_semi")
    edges = F.percentile_approx("perplexity", [low, high], 10_000)
    pool = checked.agg(edges.alias("e")).first()["e"] or [None, None]
    cuts = thresholds(checked.where(F.col("lang").isin(sorted(langs))), low, high)
    out = scored.join(F.broadcast(cuts), F.col("lang") == F.col("cut_lang"), "left").drop("cut_lang")
    out = out.withColumn("low", F.coalesce("low", F.lit(pool[0]).cast("double"))).withColumn("high", F.coalesce("high", F.lit(pool[1]).cast("double")))
    keep = (F.col("n_symbols") > 0) & F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.withColumn("keep", keep)
