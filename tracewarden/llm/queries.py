"""The registered queries of the subpackage. Each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tracewarden.llm import (
    codes,
    decontaminate,
    huffman,
    imatch,
    licenses,
    mixing,
    neardup,
    packing,
    runs,
    simhash,
    suffixes,
    toxicity,
    wrappers,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHARDS = 40
TOKENIZER = "byte_bpe_50k.json"


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies, here and on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words, weighed 3, 1, 2 by source, takes of each document."""
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a ten-word window of a benchmark item."""
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


ORACLES["op2_benchmark_decontamination"] = r"""
WITH folded AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS name, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
    SELECT DISTINCT name, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS gram
    FROM (
        SELECT name, words, least(10, len(words)) AS n,
               unnest(range(1, CAST(len(words) - least(10, len(words)) + 2 AS BIGINT))) AS i
        FROM items WHERE len(words) > 0
    )
), hits AS (
    SELECT DISTINCT d.doc_id, d.i, d.n, w.name
    FROM (
        SELECT doc_id, i, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS gram
        FROM (
            SELECT doc_id, words, n, unnest(range(1, CAST(len(words) - n + 2 AS BIGINT))) AS i
            FROM folded, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n
        )
    ) d JOIN windows w USING (n, gram)
), covered AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT doc_id, name FROM hits) GROUP BY doc_id
)
SELECT f.doc_id, CAST(len(f.words) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit,
       coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.names, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM folded f LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""


@query
def op3_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by wrappers of its host."""
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


@query
def op4_minhash_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of four-word shingles are alike to 80% or more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


ORACLES["op4_minhash_odd_sketches"] = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, hash(array_to_string(list_slice(words, i, i + 3), ' ')) AS gram
    FROM (
        SELECT doc_id, words, unnest(range(1, CAST(greatest(len(words) - 3, 1) + 1 AS BIGINT))) AS i
        FROM texts WHERE len(words) > 0
    )
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a, b
    FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
        FROM shingles x JOIN shingles y ON x.gram = y.gram AND x.doc_id <> y.doc_id
        GROUP BY x.doc_id, y.doc_id
    ) p JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 100 * shared >= 80 * (s.n + t.n - shared)
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
), least AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, l.component_id = t.doc_id AS kept
FROM texts t JOIN least l USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""


@query
def op5_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without bytes that a string of 100 has earlier."""
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents"))


@query
def op6_licence_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, as files of a tree of sources, languages and runs of 64 ids.

    A short document that states a licence stands for the licence file of a directory: by its id,
    that of its source, of its language, or of its run.
    """
    docs = table(spark, sf_dir, "documents")
    short = (F.length("text") <= 400) & F.col("text").rlike(r"(?i)licen[sc]e")
    name = F.when(short, F.concat(F.lit("LICENSE."), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    run = F.floor(F.col("doc_id") / 64).cast("string")
    high = F.when(short, F.col("doc_id") % 3)
    lang, run = F.when(F.coalesce(high != 0, F.lit(True)), F.col("lang")), F.when(F.coalesce(high == 2, F.lit(True)), run)
    path = F.concat_ws("/", F.lit(""), "source", lang, run, name)
    found = licenses.scan_licences(docs.select(path.alias("path"), "text"))
    return found.withColumn("score", F.round("score", 4))


def _licence_oracle() -> str:
    rows, foreign = licenses.template_vectors(licenses.NOTICES)
    values = ", ".join(f"({i}, '{name}', '{term}', {weight!r}::DOUBLE, {idf!r}::DOUBLE)" for i, name, term, weight, idf in rows)
    return rf"""
WITH templates(template, licence, term, weight, idf) AS (VALUES {values}),
files AS (
    SELECT '/' || source || CASE WHEN is_file AND doc_id % 3 = 0 THEN '' ELSE '/' || lang END
               || CASE WHEN is_file AND doc_id % 3 < 2 THEN '' ELSE '/' || CAST(doc_id // 64 AS VARCHAR) END AS folder,
           CASE WHEN is_file THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS name, text
    FROM (SELECT *, length(text) <= 400 AND regexp_matches(text, '(?i)licen[sc]e') AS is_file FROM documents)
), paths AS (
    SELECT folder || '/' || name AS path, folder, starts_with(name, 'LICENSE.') AS is_file, text FROM files
), cut AS (
    SELECT path, unnest(parts) AS said, unnest(range(len(parts))) AS sentence
    FROM (
        SELECT path, string_split(regexp_replace(text, '([.!?])[	

 ]+', '' || chr(10), 'g'), chr(10)) AS parts
        FROM paths WHERE regexp_matches(text, '{licenses.SPEAKS}')
    )
), terms AS (
    SELECT path, sentence, unnest(regexp_extract_all(
        translate(said, '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.TERM}')) AS term
    FROM cut WHERE regexp_matches(said, '{licenses.SPEAKS}')
), weighed AS (
    SELECT path, sentence, c.term, n * coalesce(i.idf, {foreign!r}::DOUBLE) AS w
    FROM (SELECT path, sentence, term, count(*) AS n FROM terms GROUP BY ALL) c
    LEFT JOIN (SELECT DISTINCT term, idf FROM templates) i ON i.term = c.term
), scores AS (
    SELECT path, sentence, licence, round(dot / norm, 6) AS score
    FROM (
        SELECT path, sentence, template, licence, sum(w * weight) AS dot
        FROM weighed JOIN templates USING (term) GROUP BY ALL
    ) JOIN (SELECT path, sentence, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL) USING (path, sentence)
), best AS (
    SELECT path, licence, score FROM scores WHERE score >= {licenses.LEAST}
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, licence, sentence) = 1
), held AS (
    SELECT folder, path AS from_path, licence AS given
    FROM best JOIN paths USING (path) WHERE is_file
    QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, path) = 1
), near AS (
    SELECT p.folder, arg_max(h.from_path, length(h.folder)) AS from_path, arg_max(h.given, length(h.folder)) AS given
    FROM (SELECT DISTINCT folder FROM paths) p
    JOIN held h ON p.folder = h.folder OR starts_with(p.folder, h.folder || '/') GROUP BY p.folder
)
SELECT p.path, coalesce(b.licence, h.given) AS licence, round(b.score, 4) AS score,
       CASE WHEN b.licence IS NOT NULL AND is_file THEN 'licence file' WHEN b.licence IS NOT NULL THEN 'header'
            WHEN h.given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN b.licence IS NOT NULL THEN p.path ELSE h.from_path END AS from_path
FROM paths p LEFT JOIN best b USING (path) LEFT JOIN near h ON h.folder = p.folder
"""


ORACLES["op6_licence_inheritance"] = _licence_oracle()


@query
def op7_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prints of all documents, and how they stand to an edited and to the next text."""
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


@query
def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, tokens and rows weighed in."""
    return packing.shard_listing(table(spark, sf_dir, "documents"), SHARDS)


@query
def op9_huffman_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Huffman-coded token ids, written and read back."""
    return huffman.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


@query
def op10_toxicity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, by a network trained on labelled rows that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints differ in four bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op12_limb_split_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes of eight parts, sixteen entries each, by exact integer products."""
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


def _codes_oracle(rounds: int = codes.ROUNDS) -> str:
    steps = f"""
WITH sound AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), places AS (
    SELECT r, (i - 1) // (len(v) // {codes.PARTS}) AS part, (i - 1) % (len(v) // {codes.PARTS}) AS place, v[i] AS x
    FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS i FROM sound)
), books0 AS (
    SELECT part, r - 1 AS entry, place, x AS c FROM places WHERE r <= {codes.ENTRIES}
)"""
    for i in range(rounds + 1):
        steps += f""", chosen{i} AS (
    SELECT r, part, entry, distance FROM (
        SELECT r, part, entry, sum((x - c) * (x - c)) AS distance
        FROM places JOIN books{i} USING (part, place) GROUP BY r, part, entry
    ) QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY distance, entry) = 1
)"""
        if i < rounds:
            steps += f""", means{i} AS (
    SELECT part, entry, place, (s - ((s % n) + n) % n) // n AS c
    FROM (SELECT part, entry, place, sum(x) AS s, count(*) AS n
          FROM places JOIN chosen{i} USING (r, part) GROUP BY part, entry, place)
), books{i + 1} AS (
    SELECT b.part, b.entry, b.place, coalesce(m.c, b.c) AS c
    FROM books{i} b LEFT JOIN means{i} m USING (part, entry, place)
)"""
    return steps + f""", coded AS (
    SELECT r, string_agg(printf('%02x', CAST(entry AS BIGINT)), '' ORDER BY part) AS code,
           CAST(sum(distance) AS BIGINT) AS error
    FROM chosen{rounds} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) FROM books{rounds}) AS codebooks_sha256
FROM sound JOIN coded USING (r)
"""


ORACLES["op12_limb_split_codes"] = _codes_oracle()


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, a tenth of which repeat themselves by the rule of their ids."""
    return runs.run_digests(table(spark, sf_dir, "documents"), runs.looped)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


def oracle_queries() -> dict[str, str]:
    """DuckDB SQL for the same rows, for every query that SQL can express."""
    return dict(ORACLES)
