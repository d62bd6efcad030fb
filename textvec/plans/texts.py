"""Text queries over `documents`: normalisation, pre-tokens, segmentation, token usage."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.weights import embedding_sql, weight_sql
from ..operators import vocab
from ..operators.pipeline import tokenize
from ..sources.shared import fresh_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The character classes in RE2's spelling.
_CJK = tx.CJK
_PUNCT = tx.PUNCT


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def spread(df: DataFrame) -> DataFrame:
    """A file of one row group is one task; its rows are dealt out before costly work on them.  Inputs of many splits stay."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def _text(f, spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2(f(F.col("text")), 256).alias("digest"), F.length(f(F.col("text"))).cast("long").alias("n"))


def _text_sql(expr: str) -> str:
    return f"SELECT doc_id, sha256({expr}) AS digest, length({expr}) AS n FROM documents"


def _listed(f, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each document: their number, and a digest of them joined by U+0001."""
    items = spread(documents(spark, sf_dir)).select("doc_id", f(F.col("text")).alias("items"))
    return items.select("doc_id", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", "\x01"), 256).alias("digest"))


def _listed_sql(items: str, ctes: str = "", source: str = "documents") -> str:
    return f"WITH {ctes}i AS (SELECT doc_id, {items} AS items FROM {source}) SELECT doc_id, len(items) AS n, sha256(array_to_string(items, chr(1))) AS digest FROM i"


_CLEAN = "regexp_replace(regexp_replace({t}, '[\\t\\n\\r]', ' ', 'g'), '[\\x{{FFFD}}\\p{{Cc}}\\p{{Cf}}\\p{{Co}}\\p{{Cs}}]', '', 'g')"
_STRIPPED = "strip_accents(lower(text))"
_add("clean_text", partial(_text, tx.clean_text), _text_sql(_CLEAN.format(t="text")))
_add("accent_strip", partial(_text, lambda t: tx.strip_accents(tx.decomposed(F.lower(t)))), _text_sql(_STRIPPED))
_add("cjk_isolate", partial(_text, lambda t: tx.isolate_cjk(F.concat(t, F.lit(" 界人")))), _text_sql(f"regexp_replace(text || ' 界人', '([{_CJK}])', ' \\1 ', 'g')"))
_BASIC = "list_filter(string_split_regex(regexp_replace(" + _CLEAN.format(t=_STRIPPED) + f", '([{_CJK}{_PUNCT}])', ' \\1 ', 'g'), '[\\s\\p{{Z}}]+'), lambda x: x <> '')".replace("{{", "{").replace("}}", "}")
_add("basic_tokens", partial(_listed, tx.basic_tokens), _listed_sql(_BASIC))
_add("metaspace", partial(_text, tx.metaspace), _text_sql("replace(text, ' ', '▁')"))
_SP = "CASE WHEN trim(text, ' ') = '' THEN '' ELSE '▁' || replace(regexp_replace(trim(text, ' '), ' +', ' ', 'g'), ' ', '▁') END"
_add("sp_whitespace", partial(_text, tx.sp_whitespace), _text_sql(_SP))

_BYTES = ", ".join(f"({b}, '{c.replace(chr(39), chr(39) * 2)}')" for b, c in enumerate(tx.byte_table()))
_add(
    "byte_encode",
    partial(_text, tx.byte_encode),
    f"WITH lut(b, c) AS (VALUES {_BYTES}), bytes AS (SELECT doc_id, k, ('0x' || substr(h, 2 * k - 1, 2))::INT AS b FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents), LATERAL (SELECT unnest(generate_series(1, length(h) // 2)) AS k)), "
    "joined AS (SELECT doc_id, string_agg(c, '' ORDER BY k) AS t FROM bytes JOIN lut USING (b) GROUP BY 1) SELECT doc_id, sha256(coalesce(t, '')) AS digest, length(coalesce(t, '')) AS n FROM documents LEFT JOIN joined USING (doc_id)",
)
_ASCII = [chr(c) for c in range(32, 127)] + ["\n"]
_add(
    "byte_fallback",
    partial(_listed, lambda t: tx.byte_fallback(t, _ASCII)),
    _listed_sql("flatten(list_transform(string_split(text, ''), lambda c: CASE WHEN ord(c) BETWEEN 32 AND 126 OR c = chr(10) THEN [c] ELSE list_transform(regexp_extract_all(hex(encode(c)), '..'), lambda h: '<0x' || h || '>') END))"),
)



_add("gpt2_pretokens", partial(_listed, tx.gpt2_pretokens))
_add("qwen_pretokens", partial(_listed, tx.qwen_pretokens))


def _letters(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"\p{L}+"), F.lit(0))


_add("letter_runs", partial(_listed, _letters), _listed_sql("regexp_extract_all(text, '\\p{L}+')"))
_add("number_runs", partial(_listed, lambda t: F.regexp_extract_all(t, F.lit(r"\p{N}+"), F.lit(0))), _listed_sql("regexp_extract_all(text, '\\p{N}+')"))


def added_token_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = documents(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"\. ", ".</s> ").alias("text"))
    items = marked.select("doc_id", tx.added_token_split(F.col("text"), vocab.ADDED).alias("items"))
    return items.select("doc_id", F.size("items").cast("long").alias("n"), F.size(F.filter("items", lambda x: x.startswith("</s>"))).cast("long").alias("n_added"))


_add("added_token_split", added_token_split, r"""
WITH m AS (SELECT doc_id, regexp_replace(text, '\. ', '.</s> ', 'g') AS t FROM documents),
s AS (SELECT doc_id, list_filter(string_split_regex(t, '</s>[\s\p{Z}]*'), lambda x: x <> '') AS parts, len(regexp_extract_all(t, '</s>')) AS n_added FROM m)
SELECT doc_id, len(parts) + n_added AS n, n_added FROM s""")

# Segmentation.

_PIECES = vocab.wordpiece_vocab()
_QUOTED = ", ".join("({}, '{}', {}, {})".format(k, (p[2:] if p.startswith("##") and len(p) > 2 else p).replace("'", "''"), "true" if p.startswith("##") and len(p) > 2 else "false", len(p[2:] if p.startswith("##") and len(p) > 2 else p)) for k, p in enumerate(_PIECES) if p not in vocab.SPECIALS)
SEGMENTED = f"""
RECURSIVE vocab(id, body, more, n) AS (VALUES {_QUOTED}),
tokens AS (SELECT doc_id, unnest(items) AS word, generate_subscripts(items, 1) AS k FROM (SELECT doc_id, {_BASIC} AS items FROM documents)),
words AS (SELECT DISTINCT word FROM tokens),
seg(word, done, ids) AS (
  SELECT word, 0, []::BIGINT[] FROM words WHERE length(word) <= 100
  UNION ALL
  SELECT s.word, s.done + max(v.n), list_append(s.ids, arg_max(v.id, v.n))
  FROM (SELECT *, unnest([1, 2, 3]) AS len FROM seg WHERE done < length(word)) s
  JOIN vocab v ON v.body = substr(s.word, s.done + 1, s.len) AND v.n = s.len AND v.more = (s.done > 0)
  GROUP BY s.word, s.done, s.ids),
whole AS (SELECT word, ids FROM seg WHERE done = length(word)),
pieces AS (SELECT t.doc_id, flatten(list(coalesce(w.ids, [{_PIECES.index('[UNK]')}::BIGINT]) ORDER BY t.k)) AS ids FROM tokens t LEFT JOIN whole w USING (word) GROUP BY 1),
framed AS (SELECT d.doc_id, list_concat([{_PIECES.index('[CLS]')}::BIGINT], coalesce(p.ids, []), [{_PIECES.index('[SEP]')}::BIGINT]) AS whole,
                  list_concat([{_PIECES.index('[CLS]')}::BIGINT], coalesce(p.ids, [])[1:30], [{_PIECES.index('[SEP]')}::BIGINT]) AS cut FROM documents d LEFT JOIN pieces p USING (doc_id))
"""


def _ids(kind: str, max_len: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokenize(spread(documents(spark, sf_dir)), kind, max_len)
    return out.select("doc_id", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join("ids", ","), 256).alias("digest"))


def _ids_sql(column: str) -> str:
    return f"WITH {SEGMENTED} SELECT doc_id, len({column}) AS n, sha256(array_to_string({column}, ',')) AS digest FROM framed"


_add("wordpiece_ids", partial(_ids, "wordpiece", 1 << 30), _ids_sql("whole"))


def stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ids by a stream over the table's files: stateless, so every row of every micro-batch is final."""
    path = f"{sf_dir}/documents.parquet"
    table = spark.read.parquet(path)
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 64)
    # a stream watches a folder: the table's own, or the one that its only file lies in
    alone = all(f.endswith("/documents.parquet") for f in table.inputFiles())
    rows = source.option("pathGlobFilter", "documents.parquet").parquet(sf_dir) if alone else source.parquet(path)
    ids = tokenize(rows.select("doc_id", "text"), "wordpiece", 1 << 30).select("doc_id", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join("ids", ","), 256).alias("digest"))
    out = fresh_path(spark, "stream")
    ids.writeStream.format("parquet").option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(ids.schema).parquet(out)


_add("stream_ids", stream_ids, _ids_sql("whole"))
_add("wordpiece_truncated", partial(_ids, "wordpiece", 32), _ids_sql("cut"))
_add("token_usage", lambda s, d: _ids("wordpiece", 32, s, d).agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("tokens")), f"WITH {SEGMENTED} SELECT count(*) AS texts, CAST(sum(len(cut)) AS BIGINT) AS tokens FROM framed")
_add("bpe_ids", partial(_ids, "bpe", 1 << 30))
_add("qwen_ids", partial(_ids, "qwen", 1 << 30))
_add("gemma_ids", partial(_ids, "gemma", 1 << 30))
_add("unigram_ids", partial(_ids, "sentencepiece", 1 << 30))


def fairseq_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner piece numbers to outer ids, the framing tokens moved."""
    k = F.col("id")
    return spark.range(1000).select(k.alias("piece"), F.when(k == 0, 3).when(k == 1, 0).when(k == 2, 2).otherwise(k + 1).alias("id"))


_add("fairseq_map", fairseq_map, "SELECT range AS piece, CASE range WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE range + 1 END AS id FROM range(1000)")


def vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, len(v)) for k, v in (("wordpiece", _PIECES), ("bpe", vocab.bpe_vocab()), ("gemma", vocab.gemma_vocab()[0]), ("sentencepiece", [0, 0, *vocab.unigram_pieces()]))]
    return spark.createDataFrame(rows, "kind string, size long")


_list = lambda items: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"
_SIZES = f"""WITH g AS (SELECT {_list(vocab.GROUPS)} AS g, {_list([chr(c) for c in range(33, 127)])} AS ascii, {_list("äöüßéèêçñáíóúà")} AS more),
u AS (SELECT *, list_distinct(g) AS d, list_distinct(list_transform(g, lambda x: x[1:2])) AS pairs, list_distinct(list_filter(g, lambda x: len(x) = 3)) AS threes, list_distinct(list_filter(g, lambda x: len(x) = 2)) AS twos FROM g)
SELECT unnest(['wordpiece', 'bpe', 'gemma', 'sentencepiece']) AS kind, CAST(unnest([
  5 + 26 + 10 + 32 + 36 + 2 * len(g),
  4 + 256 + len(list_distinct(list_concat(pairs, threes))) + len(twos) + 1,
  4 + 256 + len(list_distinct(flatten([['▁'], ascii, more, [chr(10)], pairs, threes, list_transform(twos, lambda x: '▁' || x)]))),
  2 + 3 + len(list_distinct(flatten([['▁'], g, list_transform(g, lambda x: '▁' || x), ascii, more])))]) AS BIGINT) AS size FROM u"""
_add("vocab_size", vocab_size, _SIZES)


def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows joined with the token table, summed up for each document: the gather as a join."""
    ids = tokenize(documents(spark, sf_dir), "wordpiece", 32).select("doc_id", F.posexplode("ids").alias("pos", "id"))
    table = spark.range(len(_PIECES)).withColumn("v", F.expr(f"transform(sequence(0, 7), j -> {embedding_sql('id', 'j')})"))
    rows = ids.join(F.broadcast(table), "id").select("doc_id", F.posexplode("v").alias("j", "x"))
    return rows.groupBy("doc_id", "j").agg((F.round(F.sum("x"), 4) + F.lit(0.0)).alias("total")).select("doc_id", F.col("j").cast("long").alias("j"), "total")


_add("embedding_lookup", embedding_lookup, f"WITH {SEGMENTED}, r AS (SELECT doc_id, unnest(cut) AS id FROM framed) SELECT doc_id, j, round(sum({embedding_sql('id', 'j')}), 4) + 0.0 AS total FROM r, range(8) b(j) GROUP BY 1, 2")


def embedding_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What enters the first layer: token, position and type rows added up; and token rows scaled by the root of the width."""
    ids = tokenize(spread(documents(spark, sf_dir)), "wordpiece", 32).select("doc_id", F.posexplode("ids").alias("pos", "id"))
    table = spark.range(len(_PIECES)).withColumn("v", F.expr(f"transform(sequence(0, 7), j -> {embedding_sql('id', 'j')})"))
    rows = ids.join(F.broadcast(table), "id").select("doc_id", "pos", F.posexplode("v").alias("j", "x"))
    added = F.col("x") + F.expr(weight_sql(5, "pos", "j")) + F.expr(weight_sql(6, "0", "j"))
    out = rows.groupBy("doc_id", "j").agg((F.round(F.sum(added), 5) + F.lit(0.0)).alias("added"), (F.round(F.max(F.col("x") * F.sqrt(F.lit(8.0))), 4) + F.lit(0.0)).alias("scaled"))
    return out.select("doc_id", F.col("j").cast("long").alias("j"), "added", "scaled")


_add("embedding_input", embedding_input, f"WITH {SEGMENTED}, r AS (SELECT doc_id, unnest(cut) AS id, generate_subscripts(cut, 1) - 1 AS pos FROM framed), x AS (SELECT doc_id, pos, j, {embedding_sql('id', 'j')} AS x FROM r, range(8) b(j)) SELECT doc_id, j, round(sum(x + {weight_sql(5, 'pos', 'j')} + {weight_sql(6, '0', 'j')}), 5) + 0.0 AS added, round(max(x * sqrt(8.0::DOUBLE)), 4) + 0.0 AS scaled FROM x GROUP BY 1, 2")


# Pre-tokens and byte-level BPE in SQL.  RE2 knows no look-ahead: where a run of white space stands before
# something else, U+0002 is put in front of its last character instead, and belongs to no token.

_W = r"\t\n\x0b\f\r\x{85}\p{Z}"


def _marked(text: str, last: str) -> str:
    return f"regexp_replace({text}, '([{_W}])([{last}][^{_W}])', '\\1\x02\\2', 'g')"


_GPT2 = f"""regexp_extract_all({_marked('text', _W)}, '''s|''t|''re|''ve|''m|''ll|''d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_W}\\p{{L}}\\p{{N}}\x02]+|[{_W}]+')"""
_LINE = _W.replace(r"\n", "").replace(r"\r", "")


def _qwen(text: str) -> str:
    return f"""regexp_extract_all({_marked(text, _LINE)}, '(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\\r\\n\\p{{L}}\\p{{N}}\x02]?\\p{{L}}+|\\p{{N}}| ?[^{_W}\\p{{L}}\\p{{N}}\x02]+[\\r\\n]*|[{_W}]*[\\r\\n]+|[{_W}]+')"""


ORACLE_SQL["gpt2_pretokens"] = _listed_sql(_GPT2)
ORACLE_SQL["qwen_pretokens"] = _listed_sql(_qwen("text"))

_MERGED = """
words AS (SELECT DISTINCT word FROM tokens),
state(word, ord, id, round) AS (
  SELECT word, ord, id, 0 FROM symbols
  UNION ALL
  SELECT s.word, s.ord - CAST(s.ord > b.at AS INT), CASE WHEN s.ord = b.at THEN b.merged ELSE s.id END, s.round + 1
  FROM state s JOIN (SELECT word, least // 1000000 AS rank, least % 1000000 AS at, merged FROM (
      SELECT a.word, min(m.rank * 1000000 + a.ord) AS least, arg_min(m.merged, m.rank * 1000000 + a.ord) AS merged
      FROM state a JOIN state n ON n.word = a.word AND n.ord = a.ord + 1 JOIN merges m ON m.l = a.id AND m.r = n.id GROUP BY a.word)) b ON s.word = b.word
  WHERE s.ord <> b.at + 1),
ends AS (SELECT word, max(round) AS round FROM state GROUP BY word),
done AS (SELECT word, list(id ORDER BY ord) AS ids FROM state JOIN ends USING (word, round) GROUP BY word),
framed AS (SELECT d.doc_id, list_concat({head}, coalesce(flatten(list(w.ids ORDER BY t.k)), []), [{tail}::BIGINT]) AS ids
           FROM documents d LEFT JOIN tokens t USING (doc_id) LEFT JOIN done w USING (word) GROUP BY d.doc_id)
SELECT doc_id, len(ids) AS n, sha256(array_to_string(ids, ',')) AS digest FROM framed"""


def _merges_sql(own: dict[str, int], merges: list[tuple[str, str]]) -> str:
    return ", ".join(f"({own[a]}::BIGINT, {own[b]}::BIGINT, {k}::BIGINT, {own[a + b]}::BIGINT)" for k, (a, b) in enumerate(merges))


def _bytes_sql(items: str, head: str) -> str:
    """Ids of byte-level BPE: a byte's token is its value, four on."""
    return f"""WITH RECURSIVE merges(l, r, rank, merged) AS (VALUES {_merges_sql(vocab.bpe_vocab(), vocab.bpe_merges())}),
tokens AS (SELECT doc_id, unnest(items) AS word, generate_subscripts(items, 1) AS k FROM (SELECT doc_id, {items} AS items FROM documents)),
symbols AS (SELECT word, ord, 4 + CAST('0x' || substr(hex(word), 2 * ord + 1, 2) AS BIGINT) AS id FROM (SELECT word, unnest(range(strlen(word))) AS ord FROM (SELECT DISTINCT word FROM tokens))),
{_MERGED.format(head=head, tail=2)}"""


ORACLE_SQL["bpe_ids"] = _bytes_sql(_GPT2, "[0::BIGINT]")
ORACLE_SQL["qwen_ids"] = _bytes_sql(_qwen("nfc_normalize(text)"), "[]::BIGINT[]")
_GEMMA, _GEMMA_MERGES = vocab.gemma_vocab()
_CHARS = ", ".join("('{}', {}::BIGINT)".format(c.replace("'", "''"), k) for c, k in _GEMMA.items() if len(c) == 1)
# no merge reaches over a mark's left side, so parts begin with marks; a character without a token is its bytes
ORACLE_SQL["gemma_ids"] = f"""WITH RECURSIVE merges(l, r, rank, merged) AS (VALUES {_merges_sql(_GEMMA, _GEMMA_MERGES)}), chars(c, id) AS (VALUES {_CHARS}),
tokens AS (SELECT doc_id, unnest(items) AS word, generate_subscripts(items, 1) AS k FROM (SELECT doc_id, regexp_extract_all(replace(text, ' ', '▁'), '(?s)▁?[^▁]+|▁') AS items FROM documents)),
letters AS (SELECT word, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS k FROM (SELECT DISTINCT word FROM tokens)),
parts AS (SELECT l.word, l.k, b.j, coalesce(chars.id, {_GEMMA['<0x00>']} + CAST('0x' || substr(hex(l.c), 2 * b.j + 1, 2) AS BIGINT)) AS id
          FROM letters l LEFT JOIN chars USING (c), LATERAL (SELECT unnest(range(CASE WHEN chars.id IS NULL THEN strlen(l.c) ELSE 1 END)) AS j) b),
symbols AS (SELECT word, row_number() OVER (PARTITION BY word ORDER BY k, j) - 1 AS ord, id FROM parts),
{_MERGED.format(head=f"[{_GEMMA['<bos>']}::BIGINT]", tail=_GEMMA['<eos>'])}"""

# Best segmentation in SQL: a row of best scores and paths for each word, one character longer each round.
_UNIGRAM = vocab.unigram_pieces()
_BODIES = ", ".join("('{}', {}::BIGINT, {!r}::DOUBLE)".format(t.replace("'", "''"), k, score) for k, (t, score, kind) in enumerate(_UNIGRAM) if kind == 1)
_LONGEST = max(len(t) for t, _, kind in _UNIGRAM if kind == 1)
_UNKNOWN = min(score for _, score, kind in _UNIGRAM if kind == 1) - 10.0
ORACLE_SQL["unigram_ids"] = f"""WITH RECURSIVE pieces(body, id, score) AS (VALUES {_BODIES}),
normal AS (SELECT doc_id, regexp_replace(trim(text, ' '), ' +', ' ', 'g') AS t FROM documents),
tokens AS (SELECT doc_id, unnest(items) AS word, generate_subscripts(items, 1) AS k FROM (SELECT doc_id, regexp_extract_all(CASE WHEN t = '' THEN '' ELSE '▁' || replace(t, ' ', '▁') END, '(?s)▁[^▁]*') AS items FROM normal)),
best(word, size, scores, paths) AS (
  SELECT DISTINCT word, 0::BIGINT, [0.0::DOUBLE], [[]::BIGINT[]] FROM tokens
  UNION ALL
  SELECT word, size + 1, list_append(any_value(scores), max(score)), list_append(any_value(paths), arg_max(path, row(score, n))) FROM (
    SELECT b.word, b.size, b.scores, b.paths, n.n AS n, b.scores[b.size + 2 - n.n] + coalesce(p.score, {_UNKNOWN!r}::DOUBLE) AS score, list_append(b.paths[b.size + 2 - n.n], coalesce(p.id, 0)) AS path
    FROM best b JOIN range(1, {_LONGEST + 1}) n(n) ON n.n <= b.size + 1 LEFT JOIN pieces p ON p.body = substr(b.word, b.size + 2 - n.n, n.n)
    WHERE b.size < length(b.word) AND (p.id IS NOT NULL OR n.n = 1))
  GROUP BY word, size),
done AS (SELECT word, list_transform(list_filter(path, lambda x, i: x <> 0 OR i = 1 OR path[i - 1] <> 0), lambda x: CASE x WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE x + 1 END) AS ids FROM (SELECT word, paths[size + 1] AS path FROM best WHERE size = length(word))),
framed AS (SELECT d.doc_id, list_concat([0::BIGINT], coalesce(flatten(list(w.ids ORDER BY t.k)), []), [2::BIGINT]) AS ids FROM documents d LEFT JOIN tokens t USING (doc_id) LEFT JOIN done w USING (word) GROUP BY d.doc_id)
SELECT doc_id, len(ids) AS n, sha256(array_to_string(ids, ',')) AS digest FROM framed"""
