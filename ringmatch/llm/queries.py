"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringmatch.llm import (
    caps,
    codebooks,
    language,
    markup,
    neighbours,
    packing,
    passages,
    secrets,
    sharding,
    simhash,
    spelling,
    token_counts,
    word_table,
)
from ringmatch.llm.common import read_table


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents repeat, where each is kept and where it is removed."""
    return passages.clustered(passages.repeated_passages(read_table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts per kind and all spans."""
    found = secrets.scan_documents(read_table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("findings", lambda x: x["rule"] == kind)).cast("long")

    spans = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["rule"], x["start"], x["stop"])), ",")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from labelled documents that are not held out."""
    return language.identify(read_table(spark, sf_dir, "documents"))


def op4_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-equal vectors."""
    return caps.near_vectors(read_table(spark, sf_dir, "embeddings"), similarity=0.9)


def op5_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, top=20)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 tokens."""
    return packing.pack_documents(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    return token_counts.count_tokens(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048
    )


def op8_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return word_table.digests(word_table.encode_documents(read_table(spark, sf_dir, "documents"), path, decode=True))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, with its layout."""
    return markup.extract_text(read_table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words_per_shingle=3, most=3)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated long word with its near words, its form and its root."""
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 40 contiguous shards of near equal bytes."""
    return sharding.shard_table(read_table(spark, sf_dir, "documents"), shards=40)


def op13_slice_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as eight codebook indexes, with its error."""
    return codebooks.compress(read_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)


QUERIES = {
    "op1_paragraph_minhash": op1_paragraph_minhash,
    "op2_secret_scan": op2_secret_scan,
    "op3_language_id": op3_language_id,
    "op4_spherical_caps": op4_spherical_caps,
    "op5_multiprobe_neighbours": op5_multiprobe_neighbours,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_counts": op7_token_counts,
    "op8_word_table": op8_word_table,
    "op9_html_text": op9_html_text,
    "op10_simhash": op10_simhash,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_byte_shards": op12_byte_shards,
    "op13_slice_codes": op13_slice_codes,
}


def _spans_sql() -> str:
    """Spans per kind: the text between matches and the matches give the places."""
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    kinds = (("assign", assign, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24))
    parts = []
    for place, (name, pattern, group, least) in enumerate(kinds):
        quoted = pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {place} AS place, '{name}' AS kind, unnest(generate_series(1, len(whole))) AS i, gaps, whole, held,
            {least} AS least FROM (SELECT doc_id, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}') AS whole,
            regexp_extract_all(t, '{quoted}', {group}) AS held FROM d WHERE regexp_matches(t, '{quoted}'))"""
        )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}),
    s AS (SELECT doc_id, place, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start, length(whole[i]) AS size
          FROM m WHERE length(held[i]) >= least),
    g AS (SELECT doc_id, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access,
            count(*) FILTER (WHERE place = 2) AS n_hex,
            string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, place) AS spans
          FROM s GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


#: CRC-32 a byte at a time: a table of 256 remainders, then one step per byte of the text.
_CRC_TABLE = """(SELECT list(r ORDER BY n) FROM (SELECT n, list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) AS r FROM range(256) AS t(n)))"""


def _crc_sql(text: str) -> str:
    """The CRC-32 of a text; a column ``crc_table`` holds the remainders."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: CAST('0x' || p AS BIGINT))"
    step = "xor(c // 256, crc_table[xor(c % 256, b) + 1])"
    return f"xor(list_reduce({data}, lambda c, b: {step}, 4294967295), 4294967295)"


def _spelling_sql() -> str:
    """Words by the contract; near words are equal when a letter is deleted from both at one place, or from one."""
    lower = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
    low AS (SELECT doc_id, {lower} AS run FROM runs WHERE length(run) >= 7),
    marked AS (SELECT run, {_crc_sql("doc_id || ':' || run")} AS h FROM low, (SELECT {_CRC_TABLE} AS crc_table)),
    cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM marked),
    v AS (SELECT word, count(*) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
    gaps AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
    keys AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS key FROM gaps),
    near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM keys a JOIN keys b USING (key, i) WHERE a.word <> b.word
             UNION SELECT a.word, b.word, b.n FROM keys a JOIN v b ON a.key = b.word
             UNION SELECT b.word, a.word, a.n FROM keys a JOIN v b ON a.key = b.word),
    ranked AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n,
               row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place FROM near),
    forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form,
              CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n
              FROM v LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (word)),
    walk AS (SELECT word, word AS here, 0 AS steps FROM v UNION ALL
             SELECT walk.word, forms.form, steps + 1 FROM walk JOIN forms ON walk.here = forms.word WHERE forms.form IS NOT NULL),
    roots AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""


def _shards_sql(shards: int) -> str:
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    s AS (SELECT doc_id, octet_length(encode(t)) + 16 AS size, {_crc_sql("t")} AS text_crc32
          FROM d, (SELECT {_CRC_TABLE} AS crc_table)),
    p AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM s),
    c AS (SELECT *, CAST(least((2 * before + size) * {shards} // (2 * total), {shards - 1}) AS INTEGER) AS shard FROM p)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM c"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every round spelled out: each part to its nearest entry, each entry to its floored mean."""
    finite = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    whole = f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"
    step = f"(len(w) // {parts})"
    ctes = [
        f"k AS MATERIALIZED (SELECT vec_id, label, {whole} AS w FROM embeddings WHERE embedding IS NOT NULL AND {finite})",
        f"p AS MATERIALIZED (SELECT vec_id, label, j AS part, w[j * {step} + 1 : (j + 1) * {step}] AS v FROM k, range({parts}) AS r(j))",
        f"""b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS e FROM p
            WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries}))""",
    ]
    square = "list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, label, part, v, min_by(entry, d * 64 + entry) AS entry, min(d) AS d
            FROM (SELECT vec_id, label, p.part, v, entry, CAST({square} AS BIGINT) AS d FROM p JOIN b{r} USING (part)) GROUP BY ALL)"""
        )
        if r < rounds:
            ctes.append(
                f"""m{r} AS MATERIALIZED (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS e FROM (
                SELECT part, entry, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM a{r})
                GROUP BY part, entry, i) GROUP BY part, entry)"""
            )
            ctes.append(
                f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{r} b LEFT JOIN m{r} m USING (part, entry))"
            )
    return f"""WITH {", ".join(ctes)},
    h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM
          (SELECT part, entry, unnest(e) AS x, unnest(range(len(e))) AS i FROM b{rounds})),
    o AS (SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
          FROM a{rounds} GROUP BY vec_id, label)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h"""


ORACLES: dict[str, str] = {
    "op11_spelling_variants": _spelling_sql(),
    "op12_byte_shards": _shards_sql(40),
    "op13_slice_codes": _codes_sql(),
    "op2_secret_scan": _spans_sql(),
    "op4_spherical_caps": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM v),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
              WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.9),
    reach AS (SELECT vec_id AS a, vec_id AS r FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.r),
    roots AS (SELECT a AS vec_id, min(r) AS component_id FROM reach GROUP BY a),
    degrees AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM roots LEFT JOIN degrees USING (vec_id)""",
}
