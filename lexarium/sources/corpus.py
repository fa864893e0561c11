"""Corpora as tables: sentences, tokens and their global positions.

Sentences are rows with a token array, so searches stay scans; tokens are exploded only where single tokens are asked
for. Positions are sums in two steps, inside ranges of the order and over one row per range, never in one ordered
window over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexarium.functions.text import lemma_stub, lemma_stubs, let, pos_stub, running_sum
from lexarium.sources.shared import dropped, kept

TOKEN = T.StructType([T.StructField("word", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("lemma", T.StringType())])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_sentences(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep's columns, line, words: the non-empty lines of documents, each with its non-empty space-separated pieces. Null texts have no lines."""
    lines = docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("line", "_text")).where("_text != ''")
    return lines.select("doc_id", *keep, "line", F.array_remove(F.split("_text", " "), "").alias("words"))


def tokens_of(words: Column) -> Column:
    """array<struct<word, pos, lemma>> with stand-ins for tagger and lemmatiser."""
    def tokens(ws: Column, ls: Column) -> Column:
        # Lemmas are found a line at a time, unless words hold spaces.
        lemma = lambda w, i: F.when(F.size(ls) == F.size(ws), F.when(w.isNotNull(), F.get(ls, i))).otherwise(lemma_stub(w))
        return F.transform(ws, lambda w, i: F.struct(w.alias("word"), pos_stub(w).alias("pos"), lemma(w, i).alias("lemma")))

    return let(words, lambda ws: let(lemma_stubs(ws), lambda ls: tokens(ws, ls)))


def running_totals(rows: DataFrame, order: list[Column], amounts: dict[str, Column]) -> DataFrame:
    """rows plus, for each name, the sum of its amount over all rows before, by order.

    Rows are dealt out by ranges of the order and written once; sums run inside a range, and what lies before a range is
    a table of one row a range, which is broadcast. Any keys will do: dense, sparse, hot or null. Equal rows stay in one
    range, one after the other.
    """
    names = [f"_k{i}" for i in range(len(order))]
    dealt = rows.withColumns(dict(zip(names, order, strict=True)) | {f"_a_{n}": c.cast("bigint") for n, c in amounts.items()})
    dealt = kept(dealt.repartitionByRange(*[F.col(n).asc_nulls_last() for n in names]).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy("_range").agg(*[F.sum(f"_a_{n}").alias(f"_t_{n}") for n in amounts])
    totals = totals.select(F.col("_range").alias("_r"), *[earlier(f"_t_{n}", Window.orderBy("_range")).alias(f"_b_{n}") for n in amounts])
    inside = Window.partitionBy("_range").orderBy(*[F.col(n).asc_nulls_last() for n in names])
    out = dealt.withColumns({n: earlier(f"_a_{n}", inside) for n in amounts}).join(F.broadcast(totals), F.col("_range") == F.col("_r"))
    return out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in amounts}).select(*rows.columns, *amounts)


def positions(sentences: DataFrame) -> DataFrame:
    """sentences (doc_id, line, words, ...) plus spos (ordinal) and cpos (tokens before), in order of doc_id (nulls last) and line. Of documents, use corpus_sentences(), which moves no words."""
    return running_totals(sentences, [F.col("doc_id"), F.col("line")], {"spos": F.lit(1), "cpos": F.size("words")})


def corpus_sentences(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """document_sentences() of docs plus spos and cpos, in order of doc_id (nulls last) and line.

    Lines and words are counted a document, and running totals are taken over these counts. They come back to the texts
    by doc_id and a hash of the text, which is all that the texts are moved for; lines are numbered inside their
    document. Documents that share a doc_id follow one another in order of that hash; equal ones are told apart by
    their place among themselves.
    """
    text = F.col("text")
    own = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.xxhash64("text", F.isnull("doc_id")).alias("_h")]
    full = docs.where("text is not null").select("doc_id", *keep, "text", *own)
    lines, words = F.size(F.array_remove(F.split(text, "\n"), "")), F.size(F.array_remove(F.split(text, "[ \n]"), ""))
    counts = full.groupBy("_id", "_h").agg(F.min("doc_id").alias("_d"), F.count("*").alias("_copies"), F.max(lines).alias("_lines"), F.max(words).alias("_words"))
    starts = running_totals(counts, [F.col("_d"), F.col("_h")], {"_s": F.col("_copies") * F.col("_lines"), "_c": F.col("_copies") * F.col("_words")})
    placed = full.join(starts.drop("_d", "_copies"), ["_id", "_h"]).withColumn("_k", F.row_number().over(Window.partitionBy("_id", "_h").orderBy("_s")) - 1)
    pieces = F.filter(F.transform(F.split(text, "\n"), lambda t, i: F.struct(i.alias("line"), F.array_remove(F.split(t, " "), "").alias("words"), (t != "").alias("on"))), lambda x: x["on"])
    before = lambda ps: F.transform(F.arrays_zip(ps.alias("p"), running_sum(F.transform(ps, lambda x: F.size(x["words"]))).alias("n")), lambda x: F.struct(x["p"]["line"].alias("line"), x["p"]["words"].alias("words"), (x["n"] - F.size(x["p"]["words"])).alias("before")))
    rows = placed.select("doc_id", *keep, (F.col("_s") + F.col("_k") * F.col("_lines")).alias("_s"), (F.col("_c") + F.col("_k") * F.col("_words")).alias("_c"), F.posexplode(let(pieces, before)).alias("_i", "_x"))
    return rows.select("doc_id", *keep, "_x.line", "_x.words", (F.col("_s") + F.col("_i")).alias("spos"), (F.col("_c") + F.col("_x.before")).alias("cpos"))


def read_vertical(spark: SparkSession, path: str, limit_lines: int | None = None, limit_sentences: int | None = None, limit_bytes: int | None = None) -> DataFrame:
    """spos, sentence_id, cpos, tokens from a one-token-per-line file.

    A line starting `<s` opens a sentence, closing an open one; `</s>` closes it; other `<...>` lines without a tab and
    blank lines count for nothing; a token is word, pos, lemma (or the word) by tabs; tokens outside sentences advance
    cpos only; a sentence that nothing closes is dropped; one without tokens has the cpos of the next token.
    """
    line, raw = F.col("value"), spark.read.text(path)
    opens, closes = line.startswith("<s") & line.rlike("^<s[ >]|^<s$"), line.startswith("</s>")
    token = ~opens & ~closes & (F.trim(line) != "") & (~line.startswith("<") | line.contains("\t"))
    kind = F.when(opens, _OPEN).when(closes, _CLOSE).when(token, _TOKEN).otherwise(_OTHER)
    text = F.when(opens, F.regexp_extract(line, 'id="([^"]*)"', 1)).when(token, line)
    raw = raw.select(F.xxhash64("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_at"), kind.alias("_kind"), text.alias("_text"), (F.octet_length(line) + 1).cast("long").alias("_bytes"))
    # The files' names, without their content: splits are put in order by them, and lines needn't carry them.
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("_f"), F.col("_metadata.file_path").alias("_path"))
    order = Window.orderBy("_path", "_at")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    if limit_lines is not None or limit_bytes is not None:
        sizes = raw.groupBy("_f", "_at").agg(F.count("*").alias("_n"), F.sum("_bytes").alias("_m")).join(F.broadcast(files), "_f")
        raw = raw.join(F.broadcast(sizes.select("_f", "_at", before("_n").alias("_line0"), before("_m").alias("_byte0"))), ["_f", "_at"])
    else:
        raw = raw.drop("_bytes")
    found = kept(raw.mapInArrow(lambda batches: _vertical_pieces(batches, limit_lines, limit_bytes), _PIECES), "pieces")
    splits = found.where(F.col("_part") == _SPLIT).join(F.broadcast(files), "_f")
    shut = F.coalesce(F.last("_closed", True).over(upto), F.lit(True))
    splits = splits.select("_f", "_at", before("_open").alias("_open0"), before("_toks").alias("_toks0"), shut.alias("_shut0"), F.sum("_open").over(Window.partitionBy()).alias("_last"))
    placed = found.where(F.col("_part") != _SPLIT).join(F.broadcast(splits), ["_f", "_at"])
    lines = F.when((F.col("_open") > 0) | ~F.col("_shut0"), F.col("_tokens"))
    placed = placed.select("_part", (F.col("_open") + F.col("_open0")).alias("_n"), "_id", (F.col("_toks") + F.col("_toks0")).alias("_first"), lines.alias("_ts"), "_closed", "_last")
    whole = placed.where(F.col("_part") == _WHOLE).select("_n", "_id", "_first", "_ts")
    parts = placed.where((F.col("_part") == _PIECE) & (F.col("_n") > 0)).groupBy("_n").agg(
        F.max("_id").alias("_id"), F.min(F.when(F.col("_id").isNotNull(), F.col("_first"))).alias("_first"),
        F.sort_array(F.collect_list(F.when(F.col("_ts").isNotNull(), F.struct("_first", "_ts")))).alias("_ps"), F.max("_closed").alias("_closed"), F.max("_last").alias("_last"),
    )
    parts = parts.where("_closed or _n < _last").select("_n", "_id", "_first", F.flatten(F.transform("_ps", lambda x: x["_ts"])).alias("_ts"))
    fields = lambda p: F.struct(F.get(p, 0).alias("word"), F.coalesce(F.get(p, 1), F.lit("")).alias("pos"), F.coalesce(F.get(p, 2), F.get(p, 0)).alias("lemma"))
    spos = F.col("_n") - 1
    out = whole.union(parts).select(spos.alias("spos"), F.when(F.coalesce("_id", F.lit("")) != "", F.col("_id")).otherwise(spos.cast("string")).alias("sentence_id"), F.col("_first").alias("cpos"), F.transform("_ts", lambda x: let(F.split(x, "\t"), fields)).alias("tokens"))
    return out if limit_sentences is None else out.where(F.col("spos") < limit_sentences)


_OPEN, _CLOSE, _TOKEN, _OTHER = range(4)
_WHOLE, _PIECE, _SPLIT = range(3)
_PIECES = "_f long, _at long, _part int, _open long, _toks long, _closed boolean, _id string, _tokens array<string>"


def _vertical_pieces(batches: Iterator[pa.RecordBatch], limit_lines: int | None, limit_bytes: int | None) -> Iterator[pa.RecordBatch]:
    """The sentences of a task's lines: whole ones, pieces of those that go over the edge of a batch or split, and a row of sums for each split.

    A row has its sentence's number in the split (0: an earlier split opened it), the tokens before it there, whether a
    mark closes it, its id if it is opened here, and its token lines. In a row of sums these are the split's sentences
    and tokens, and whether it ends outside a sentence (null: it has no marks).
    """
    names = [f.split()[0] for f in _PIECES.split(", ")]
    key, opened, toks, lines, size, shut = None, 0, 0, 0, 0, None

    def rows(key, part, opened, toks, closed, ids, tokens) -> pa.RecordBatch:
        n = len(part)
        columns = [pa.array([k] * n, pa.int64()) for k in key] + [pa.array(part, pa.int32()), pa.array(opened, pa.int64()), pa.array(toks, pa.int64()), pa.array(closed, pa.bool_()), ids, tokens]
        return pa.RecordBatch.from_arrays(columns, names)

    def sums() -> pa.RecordBatch:
        return rows(key, [_SPLIT], [opened], [toks], [shut], pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.string())))

    for batch in batches:
        f, at = (batch.column(c).to_numpy() for c in (0, 1))
        edges = [0, *(np.flatnonzero((np.diff(f) != 0) | (np.diff(at) != 0)) + 1), batch.num_rows] if batch.num_rows else []
        for low, high in zip(edges, edges[1:]):
            here = (int(f[low]), int(at[low]))
            if here != key:
                if key is not None:
                    yield sums()
                key, opened, toks, lines, size, shut = here, 0, 0, 0, 0, None
            part = batch.slice(low, high - low)
            kind, text = part.column(2).to_numpy(), part.column(3)
            if part.num_columns > 4:
                width, line0, byte0 = (part.column(part.schema.names.index(c)).to_numpy() for c in ("_bytes", "_line0", "_byte0"))
                ends, n = size + np.cumsum(width), lines + np.arange(1, len(kind) + 1)
                lines, size = int(n[-1]), int(ends[-1])
                on = np.ones(len(kind), bool)
                if limit_lines is not None:
                    on &= line0 + n <= limit_lines
                if limit_bytes is not None:
                    on &= byte0 + ends - width < limit_bytes
                kind, text = kind[on], text.filter(pa.array(on))
            if not len(kind):
                continue
            is_open, is_token = kind == _OPEN, kind == _TOKEN
            place = np.arange(len(kind))
            # A place's last mark that opens and last that closes; -1 is the state before the first place.
            last_open = np.maximum.accumulate(np.where(is_open, place, -1))
            last_close = np.maximum.accumulate(np.where(kind == _CLOSE, place, -1))
            inside = (last_open > last_close) | ((last_open < 0) & (last_close < 0) & (shut is not True))
            number, held = np.cumsum(is_open), is_token & inside
            count = int(number[-1])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(number[held], minlength=count + 1))])
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text.filter(pa.array(held)))
            closed = np.bincount(number[kind == _CLOSE], minlength=count + 1) > 0
            first = np.concatenate([[toks], toks + np.cumsum(is_token)[is_open]])
            ids = pa.concat_arrays([pa.nulls(1, pa.string()), text.filter(pa.array(is_open))])
            whole = np.full(count + 1, _WHOLE)
            whole[[0, -1]] = _PIECE
            start = 0 if offsets[1] or closed[0] else 1  # nothing of an earlier sentence
            if start <= count:
                yield rows(key, whole[start:], opened + np.arange(start, count + 1), first[start:], closed[start:], ids[start:], tokens[start:])
            if last_open[-1] >= 0 or last_close[-1] >= 0:
                shut = bool(last_close[-1] > last_open[-1])
            opened, toks = opened + count, toks + int(is_token.sum())
    if key is not None:
        yield sums()


def vertical_lines(sentence_id: Column, tokens: Column) -> Column:
    """array<string>: a sentence's lines in a one-token-per-line file. White space inside fields that would end a field or line reads as a space; a word that would read as a sentence's mark gets a full-width bracket."""
    field = lambda x: F.translate(F.coalesce(x, F.lit("")), "\t\r\n", "   ")
    word = lambda w: let(field(w), lambda x: F.when(x.startswith("<"), F.regexp_replace(x, "^<(?=/?s[ >]|/?s$)", "\uff1c")).otherwise(x))
    mark = F.concat(F.lit('<s id="'), F.replace(field(sentence_id.cast("string")), F.lit('"'), F.lit("'")), F.lit('">'))
    line = lambda t: F.concat(word(t["word"]), F.lit("\t"), field(t["pos"]), F.lit("\t"), field(t["lemma"]))
    return F.concat(F.array(mark), F.transform(tokens, line), F.array(F.lit("</s>")))


def write_vertical(sentences: DataFrame, path: str, sentence_id: str = "spos", order: str = "spos", mode: str = "error") -> None:
    """sentences (order, sentence_id, tokens) as vertical text in files whose names follow the order; what read_vertical() reads again. Sentences are dealt by ranges of the order, so any number of tasks writes."""
    text = F.array_join(vertical_lines(F.col(sentence_id), F.col("tokens")), "\n", "")  # one value a sentence is moved
    # Written once: else the look for ranges, the filter and the shuffle each make all lines anew.
    made = kept(sentences.select(F.col(order).alias("_o"), text.alias("value")), "lines")
    dealt = made.where("value is not null").repartitionByRange("_o").sortWithinPartitions("_o")
    dealt.select("value").write.mode(mode).text(path)
    dropped(made)


def concordance_markup(number: Column, tokens: Column, first: Column, length: Column) -> Column:
    """A concordance line as parse_concordance() reads it, with a match of `length` tokens from place `first`."""
    text = lambda t: F.concat(F.lit("<TOKEN>"), t["word"], F.lit("/"), t["pos"], F.lit("/"), t["lemma"], F.lit("</TOKEN>"))
    part = lambda a: F.array_join(F.transform(a, text), " ")
    inside = lambda low, high: F.filter(tokens, lambda t, i: (i >= low) & (i < high))
    zero, end = F.lit(0), first + length
    return F.concat(F.lit("<LINE><MATCHNUM>"), number.cast("string"), F.lit("</MATCHNUM><CONTENT>"), part(inside(zero, first)), F.lit("<MATCH>"), part(inside(first, end)), F.lit("</MATCH>"), part(inside(end, F.size(tokens))), F.lit("</CONTENT></LINE>"))


def parse_concordance(text: Column) -> Column:
    """array<struct<cqp_id, tokens, match_index>> from concordance markup; a token is word/pos/lemma split at its last two slashes, with UNK and the word standing in."""
    lines = F.regexp_extract_all(text, F.lit(r"(?s)<LINE>(.*?)</LINE>"), 1)

    ends = "[\n\r\u0085\u2028\u2029]"

    def token(raw: Column, odd: Column) -> Column:
        joined = lambda p, n: F.array_join(F.slice(p, F.lit(1), n), "/")

        def parts(p: Column) -> Column:
            n = F.size(p)
            word = F.when(n <= 3, F.get(p, 0)).otherwise(joined(p, n - 2))
            two = lambda w: F.struct(w.alias("word"), F.element_at(p, -1).alias("pos"), w.alias("lemma"))
            whole = F.struct(word.alias("word"), F.element_at(p, -2).alias("pos"), F.element_at(p, -1).alias("lemma"))
            # Three parts are looked for on one line only.
            return F.when(n == 1, F.struct(raw.alias("word"), F.lit("UNK").alias("pos"), raw.alias("lemma"))).when(n == 2, two(word)).when(odd & word.rlike(ends), two(joined(p, n - 1))).otherwise(whole)

        return let(F.split(raw, "/", -1), parts)

    def row(line: Column) -> Column:
        found = lambda s: F.filter(F.regexp_extract_all(s, F.lit(r"(?s)<TOKEN>(.*?)</TOKEN>"), 1), lambda t: F.trim(t) != "")
        tokens = let(line.rlike(ends), lambda odd: F.transform(found(line), lambda t: token(t, odd)))
        return F.struct(F.regexp_extract(line, r"<MATCHNUM>\s*(\d+)\s*</MATCHNUM>", 1).try_cast("bigint").alias("cqp_id"), tokens.alias("tokens"), F.size(found(F.substring_index(line, "<MATCH>", 1))).alias("match_index"))

    return F.transform(lines, row)
