"""One query for each operator, over its whole table and with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.collocations import collocations
from weir.llm.dedup import near_duplicates
from weir.llm.infill import fill_in_middle, restored
from weir.llm.language import language_scores
from weir.llm.licenses import PERCENT, SMALLEST_BLOCK, TEMPLATES, find_licenses
from weir.llm.media import read_media, store_media
from weir.llm.packing import pack
from weir.llm.personal import find_personal, joined
from weir.llm.pieces import encode
from weir.llm.registry import ORACLES, QUERIES, query, table
from weir.llm.search import top_k
from weir.llm.secrets import find_secrets, joined_spans
from weir.llm.shards import sequences, write_shards
from weir.llm.toxicity import toxicity

__all__ = ["ORACLES", "QUERIES"]


@query()
def op9_media(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as frames of an ISO media file, read back by its boxes."""
    stored = store_media(table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    i = "info."
    return read_media(stored).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.octet_length(i + "payload").cast("long").alias("payload_bytes"),
        F.sha2(i + "payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(info.payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            "|", i + "codec", i + "width", i + "height", i + "timescale", i + "duration", i + "samples", F.size(i + "keyframes"),
            F.concat_ws(",", F.transform(i + "keyframes", lambda k: F.concat_ws("-", k["start"], k["end"]))),
        ).alias("feature"),
    )


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """Packed pieces with a checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens")


@query()
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, one row for each piece."""
    return pieces_digest(pack(table(spark, folder, "documents")))


@query(
    """
    WITH RECURSIVE tokens AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents
    ), grams AS (
        SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
        FROM tokens
    ), one AS (SELECT doc_id, unnest(s) AS g FROM grams),
    rare AS (SELECT g FROM one GROUP BY g HAVING count(*) > 1),
    shared AS (
        SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM (SELECT * FROM one SEMI JOIN rare USING (g)) a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
    ), links AS (
        SELECT u, v FROM shared JOIN grams x ON x.doc_id = u JOIN grams y ON y.doc_id = v WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)
    ), reach(doc_id, seen) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT links.u, seen FROM reach JOIN links ON links.v = reach.doc_id
    )
    SELECT doc_id, len(s)::BIGINT AS n_shingles, min(seen) AS component_id, doc_id = min(seen) AS kept
    FROM grams JOIN reach USING (doc_id) GROUP BY doc_id, s
    """
)
def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, folder, "documents")).drop("n_links")


@query()
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score of every document."""
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every text."""
    spans = F.col("spans")
    count = {f"n_{kind}": F.size(F.expr(f"filter(spans, s -> s.kind = '{kind}')")).cast("long") for kind in ("assign", "access", "hex")}
    return find_secrets(table(spark, folder, "documents")).select(
        "doc_id", *[column.alias(name) for name, column in count.items()],
        F.sha2(joined_spans(spans, "assign", "access", "hex"), 256).alias("base_sha256"), joined_spans(spans).alias("spans"),
    )


@query()
def op5_language_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probabilities of every text."""
    return language_scores(table(spark, folder, "documents"))


@query(
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    ), r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """
)
def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best matches of every hundredth vector."""
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op6_personal(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text."""
    spans = F.col("spans")
    base = ("email", "ip", "card", "phone")
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in base]
    return find_personal(table(spark, folder, "documents")).select("doc_id", *counts, F.sha2(joined(spans, base), 256).alias("base_sha256"), joined(spans).alias("spans"))


@query()
def op8_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as token shards in training order, one row for each sequence as read back."""
    return sequences(write_shards(table(spark, folder, "documents")))


@query()
def op1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as ids of pieces, and the text that they give back."""
    return encode(table(spark, folder, "documents"), back=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("text_sha256")
    )


@query(
    """
    WITH w AS (
        SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
        FROM (SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
    ), grams AS (
        SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: w[i:i + size - 1])) AS g FROM w, (VALUES (1), (2), (3)) s(size)
    ), f AS (SELECT lang, g, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
    candidates AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 10),
    cuts AS (
        SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, (1000000 * c.a * c.a) // (x.f * y.f) AS score
        FROM candidates c JOIN (VALUES (1), (2)) t(k) ON k < len(c.g) JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:len(c.g)]
    ), lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM cuts),
    inside AS (
        SELECT c.lang, p.g FROM candidates c, (VALUES (1), (2)) t(i) JOIN candidates p ON p.lang = c.lang AND p.g = c.g[i:i + 1] WHERE len(c.g) = 3 AND 100 * c.a >= 50 * p.a
    ), kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM lowest ANTI JOIN inside USING (lang, g) WHERE place = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
    FROM ranked JOIN (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang) USING (lang) WHERE rank <= 2000
    """
)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return collocations(table(spark, folder, "documents"))


def _license_sql() -> str:
    """Every block against every template, from the definition."""
    templates = ",\n".join(f"({number}, '{label}', '{body}')" for number, (label, body) in enumerate(TEMPLATES))
    return f"""
    WITH t AS (
        SELECT label, list_distinct(w) AS words, greatest({SMALLEST_BLOCK}, pow(2, ceil(log2(2 * len(w))))::BIGINT) AS level
        FROM (SELECT number, label, regexp_extract_all(lower(body), '[0-9a-z]+') AS w FROM (VALUES {templates}) v(number, label, body))
    ), d AS (
        SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
        FROM documents
    ), blocks AS (
        SELECT doc_id, level, list_distinct(w[s + 1:s + level]) AS words
        FROM (SELECT doc_id, w, level, unnest(range(0, greatest(len(w) - level, 0) + level // 2, level // 2)) AS s FROM d, (SELECT DISTINCT level FROM t))
    ), met AS (
        SELECT doc_id, label, len(list_intersect(b.words, t.words)) / len(t.words) AS share FROM blocks b JOIN t USING (level)
        WHERE 100 * len(list_intersect(b.words, t.words)) >= {PERCENT} * len(t.words)
    ), more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM met GROUP BY doc_id),
    phrases AS (SELECT label, string_split(body, ' ') AS p FROM (VALUES ('mit license', 'mit'), ('apache license', 'apache'), ('general public license', 'gpl')) v(body, label)),
    places AS (
        SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS at FROM d, phrases
    ), base AS (SELECT doc_id, count(*) AS n_base, min(at) AS first_word, max(at) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
        array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
        CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
    FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
    """


@query(_license_sql())
def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and license texts in every document; the score is the largest share of a template or phrase found."""
    base, more = F.col("places"), F.col("blocks")
    return find_licenses(table(spark, folder, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base["start"]).alias("first_word"), F.array_max(base["start"]).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(base["label"]))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base["label"], more["label"])))).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(more["share"]), F.lit(0.0))).alias("score"),
    )


@query(
    """
    WITH x AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
    u AS (
        SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u,
            [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN [0, 1, 2, 3]] AS h
        FROM x
    ), c AS (
        SELECT *, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM u
    ), p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
    SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM p
    """
)
def op13_infill(spark: SparkSession, folder: str) -> DataFrame:
    """Every text rearranged for filling in the middle, and what is restored of it."""
    made = fill_in_middle(table(spark, folder, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
