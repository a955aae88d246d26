"""One query per operator over the whole documents table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.backoff_lm import score_documents
from tidemark.llm.exact_dedup import dedup_in_loads
from tidemark.llm.language_id import fit_centroids, language_of
from tidemark.llm.merkle import merkle_manifest
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_jaccard import near_duplicate_classes
from tidemark.llm.phrases import collocations
from tidemark.llm.quality_rules import fit_rules, judged
from tidemark.llm.sentencepieces import SentencePieces
from tidemark.llm.sharding import place
from tidemark.llm.simhash import simhash_classes
from tidemark.llm.token_counts import section_token_counts
from tidemark.llm.toxicity import fit_network, toxicity_of

#: Shards of op4.
SHARDS = [f"shard-{k:03d}" for k in range(96)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _fifth(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_in_loads(_table(spark, sf_dir, "documents")).drop("keep_rows")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(_table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n_chars")), SHARDS)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    digest = SentencePieces(docs, tokenizer_file("piece_bpe_32k.model")).digest(F.col("text"))
    return docs.select("doc_id", digest.alias("d")).select("doc_id", "d.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    network = fit_network(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", _fifth().alias("held_out"), toxicity_of(docs, network, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", F.round("first_time", 9).alias("first_time"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_of(docs, fit_centroids(docs), F.col("text"))
    return docs.select("doc_id", _fifth().alias("held_out"), found.alias("l")).select("doc_id", "held_out", "l.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = fit_rules(docs, _table(spark, sf_dir, "labels"))
    out = judged(docs.select("doc_id", "text"), rules)
    counts = [F.col(f"_stats.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *counts, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(_table(spark, sf_dir, "documents")).drop("copies")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents")).drop("first_doc_id", "first_word")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_exact_dedup,
        op3_token_counts,
        op4_sharding,
        op5_sentencepiece,
        op6_toxicity,
        op7_lm_scoring,
        op8_mixing,
        op9_language_id,
        op10_quality_rules,
        op11_simhash_near_dedup,
        op12_phrase_collocations,
        op13_merkle_manifest,
    )
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _said(*columns: str) -> str:
    return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


def _levels(first: str) -> str:
    """Nodes of all levels above those of `first` (tree, pos, n, d)."""
    return f"""SELECT tree, 0 AS level, pos, n, d FROM {first}
  UNION ALL SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(d || coalesce(e, '')) FROM (SELECT *, lead(d) OVER (PARTITION BY tree ORDER BY pos) AS e FROM {{}}) WHERE pos % 2 = 0 AND n > 1"""


def _ways(first: str, nodes: str) -> str:
    """Siblings of each of `first` by level, with the side on which they are."""
    return f"""SELECT f.tree, f.pos, list(CASE WHEN s.d IS NULL THEN '-' WHEN s.pos < (f.pos >> l.level) THEN 'L' || s.d ELSE 'R' || s.d END ORDER BY l.level) FILTER (l.level IS NOT NULL) AS way
  FROM {first} f LEFT JOIN (SELECT DISTINCT tree, level FROM {nodes} WHERE n > 1) l ON l.tree = f.tree
  LEFT JOIN {nodes} s ON s.tree = f.tree AND s.level = l.level AND s.pos = xor(f.pos >> l.level, 1) GROUP BY ALL"""


_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, bit: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""

ORACLE_SQL = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * i >= 80 * (na + nb - i)),
r AS (SELECT doc_id AS d, doc_id AS m FROM s UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.d WHERE r.m < l.b OR r.m = r.d)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.m) AS component_id
FROM s JOIN r ON r.d = s.doc_id GROUP BY s.doc_id, len(s.g)
""",
    "op2_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
""",
    "op12_phrase_collocations": rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, {_FOLDED} AS text FROM documents),
p AS (SELECT row_number() OVER () AS id, lang, {_WORDS.replace("x09-\x0D", "x09").format("piece")} AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS words
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, words, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE words = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE words > 1 AND a >= 100),
s AS (SELECT lang, phrase, words, a, string_split(phrase, ' ') AS w FROM c),
u AS (SELECT s.lang, s.phrase, s.a, k, x.a AS l, y.a AS r, n.n, 1000 * s.a::HUGEINT * n.n::HUGEINT // (x.a::HUGEINT * y.a::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM s) s
  JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[:k], ' ')
  JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[k + 1:], ' ') JOIN n ON n.lang = s.lang),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c z ON z.lang = c.lang AND z.words > c.words AND z.a >= c.a AND contains(' ' || z.phrase || ' ', ' ' || c.phrase || ' ')),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b ANTI JOIN d USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE x AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_said("doc_id", "source", "lang", "n_chars", "text")}) AS d,
    sha256({_said("doc_id", "source", "lang", "(n_chars + 1)", "text")}) AS bad, coalesce({_CRC32.format("doc_id")} % 7 = 0, false) AS tampers FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM x),
low AS ({_levels("a").format("low")}),
b AS (SELECT tree AS own, '' AS tree, d, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS ({_levels("b").format("high")}),
wa AS ({_ways("a", "low")}), wb AS ({_ways("b", "high")}),
w AS (SELECT a.doc_id, a.d AS leaf, b.d AS subroot, (SELECT d FROM high WHERE n = 1) AS root, CASE WHEN a.tampers THEN a.bad ELSE a.d END AS start,
  list_concat(wa.way, wb.way) AS way FROM a JOIN b ON b.own = a.tree JOIN wa ON wa.tree = a.tree AND wa.pos = a.pos JOIN wb ON wb.pos = b.pos)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(list_filter(way, lambda s: s <> '-'), lambda s: s[2:]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT *, list_reduce(list_prepend(start, coalesce(way, [])), lambda h, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || h) WHEN 'R' THEN sha256(h || s[2:]) ELSE sha256(h) END) AS folded_root FROM w)
""",
}
