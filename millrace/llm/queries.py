"""Named queries over the standard tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    collocations,
    exact,
    jaccard,
    languages,
    leaks,
    licences,
    packing,
    quality,
    ranked,
    substring,
    suffixes,
    token_counts,
    token_files,
    workers,
)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    workers.reach(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality.quality_scores(documents(spark, folder), labels, threshold=0.7)


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder), vocabulary("piece_bpe_32k.model"), limit=4096)


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(documents(spark, folder), vocabulary("word_bpe_49k.json"), end_id=1)


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder), vocabulary("word_bpe_49k.json"), end_id=2, window=4096)


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeated_words(documents(spark, folder), window=20)


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(documents(spark, folder), length=50)


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, folder))


def op6_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.find_licences(documents(spark, folder))


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, folder), percent=90, words=3)


def op10_leaks(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return leaks.find_leaks(documents(spark, folder), benchmark)


def op11_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    dictionaries = languages.fit_dictionaries(docs.where(~held_out))
    scored = languages.identify_languages(docs, dictionaries)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op12_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.ranked_search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), k=10)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(documents(spark, folder), longest=3, least=10, contained_percent=50, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_token_files": op3_token_files,
    "op4_packing": op4_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_licences": op6_licences,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op10_leaks": op10_leaks,
    "op8_exact_dedup": op8_exact_dedup,
    "op11_languages": op11_languages,
    "op12_ranked": op12_ranked,
    "op13_collocations": op13_collocations,
}

#: Words of a text, its A-Z lower-cased or not.
_WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = "regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op5_substring_dedup": f"""
    WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
    windows AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS key
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w)),
    later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY key ORDER BY doc_id, p) AS n
      FROM windows) WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS k FROM later),
    words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM w)
    SELECT w.doc_id, CAST(count(words.k) AS BIGINT) AS n_words, CAST(count(gone.k) AS BIGINT) AS n_removed,
      sha256(coalesce(string_agg(word, ' ' ORDER BY words.k) FILTER (WHERE gone.k IS NULL), '')) AS kept_sha256
    FROM w LEFT JOIN words ON words.doc_id = w.doc_id
      LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k GROUP BY w.doc_id""",
    "op7_jaccard_join": f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, key FROM (
      SELECT doc_id, array_to_string(ws[p:p + 2], ' ') AS key
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3)
      UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2)),
    n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.key = b.key AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
      WHERE 100 * common >= 90 * (nx.size + ny.size - common)),
    edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
    reach AS (SELECT doc_id, doc_id AS root FROM documents UNION
      SELECT edges.y, reach.root FROM reach JOIN edges ON edges.x = reach.doc_id)
    SELECT d.doc_id, CAST(coalesce(n.size, 0) AS BIGINT) AS n_shingles, r.component_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
      JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id""",
    "op8_exact_dedup": """
    WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
    groups AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain.t) AS text_sha256
    FROM plain JOIN groups ON plain.t = groups.t""",
    "op12_ranked": f"""
    WITH terms AS (SELECT doc_id, {_TERMS.format(text=_LOWER)} AS ws FROM documents),
    postings AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS w FROM terms) GROUP BY doc_id, w),
    sizes AS (SELECT doc_id, len(ws) AS n FROM terms),
    total AS (SELECT count(*) FILTER (WHERE n > 0) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
    wanted AS (SELECT DISTINCT item_id, unnest({_TERMS.format(text=_LOWER)}) AS w FROM benchmark),
    weights AS (SELECT w, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
      FROM postings, total GROUP BY w),
    scores AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
      FROM wanted JOIN weights USING (w) JOIN postings USING (w) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id)
    SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id
      ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0) WHERE place <= 10""",
    "op13_collocations": f"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
    grams AS (
      SELECT lang, unnest(ws) AS phrase, 1 AS size FROM lists UNION ALL
      SELECT lang, array_to_string(ws[p:p + 1], ' '), 2 FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS p FROM lists) UNION ALL
      SELECT lang, array_to_string(ws[p:p + 2], ' '), 3 FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS p FROM lists)),
    f AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS a FROM grams GROUP BY lang, phrase HAVING count(*) >= 10),
    totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM lists GROUP BY lang),
    cuts AS (SELECT f.lang, phrase, size, a, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
    scores AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r,
        CAST((1000000 * CAST(c.a AS HUGEINT) * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
      FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(ws, 1, k), ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(ws, k + 1, c.size), ' ')),
    lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    extended AS (SELECT lang, part, max(a) AS longer FROM (
        SELECT lang, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS part, a FROM f WHERE size = 3 UNION ALL
        SELECT lang, array_to_string(string_split(phrase, ' ')[2:3], ' '), a FROM f WHERE size = 3) GROUP BY lang, part),
    kept AS (SELECT lowest.* FROM lowest LEFT JOIN extended e ON e.lang = lowest.lang AND e.part = lowest.phrase
      WHERE e.longer IS NULL OR 100 * e.longer < 50 * a)
    SELECT kept.lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang
      ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) AS kept JOIN totals USING (lang) WHERE rank <= 2000""",
}
