"""One query for each operator, with production parameters over the whole given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ripplework.llm import classifier as cl
from ripplework.llm import cover_codes as cc
from ripplework.llm import language_id as li
from ripplework.llm import lexicon_bpe as lb
from ripplework.llm import license_scan as ls
from ripplework.llm import line_dedup as ld
from ripplework.llm import merkle as mk
from ripplework.llm import mixing as mx
from ripplework.llm import packing as pk
from ripplework.llm import quality_rules as qr
from ripplework.llm import simhash as sh
from ripplework.llm import suffix_dedup as sd
from ripplework.llm import topk_search as ts
from ripplework.llm.registry import query, table
from ripplework.session import checkpointed


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = li.identify(docs, li.learn(docs))
    return found.select("doc_id", li.held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score", "rejected")


OP4_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM t)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n >= 2),
reps AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT t.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words
  FROM t JOIN lines USING (doc_id) LEFT JOIN reps USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END) AS policy_failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, policy_failures = 0 AS kept,
  CAST(policy_failures AS BIGINT) AS policy_failures FROM f
"""


@query("op4_quality_rules", OP4_SQL)
def op4(spark, sf_dir):
    book = qr.judge(qr.ledger(table(spark, sf_dir, "documents")), qr.POLICIES[qr.PRODUCTION])
    book = qr.judge(book, qr.BASE_MASK, "base_passed")
    return book.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "not base_passed as base_failed", "kept",
        f"failures & {qr.POLICIES[qr.PRODUCTION]}L as policy_failures",
    )


@query("op9_simhash_near_dedup")
def op9(spark, sf_dir):
    found = sh.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
  CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op3_exact_topk", OP3_SQL)
def op3(spark, sf_dir):
    vectors = ts.whole(table(spark, sf_dir, "embeddings"))
    return ts.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


def vocabulary() -> tuple[str, str, str]:
    """The vocabulary that documents are packed with."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    return pk.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    features = cl.featured(docs)
    return cl.score_features(features, cl.learn(docs, table(spark, sf_dir, "labels"), features=features))


def _rake_sql(rounds: int) -> str:
    parts, last = [], "c0"
    for n in range(rounds):
        for name in mx.DIMENSIONS:
            raked = f"CASE WHEN sum(weight) OVER w > 0 THEN weight * aim_{name} / sum(weight) OVER w ELSE 0 END"
            now = f"c{n}_{name}"
            weight = f"least({raked}, tokens)" if name == mx.DIMENSIONS[-1] else raked
            parts.append(
                f"{now} AS MATERIALIZED (SELECT source, lang, topic, tokens, {weight} AS weight, aim_source, aim_lang, aim_topic"
                f" FROM {last} WINDOW w AS (PARTITION BY {name}))"
            )
            last = now
    return ",\n".join(parts) + f",\nraked AS (SELECT * FROM {last})"


_AIMS = ",\n".join(
    f"a_{name} AS MATERIALIZED (SELECT {name}, p / sum(p) OVER () * {mx.KEEP} * (SELECT sum(tokens) FROM cells) AS aim_{name} FROM"
    f" (SELECT {name}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {t}) ELSE 0 END AS p FROM cells GROUP BY 1))"
    for name, t in mx.TEMPERATURES.items()
)
OP7_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  CASE WHEN contains(lower(text), 'licens') OR contains(lower(text), 'copyright') THEN 'legal' WHEN contains(text, '@') THEN 'contact'
  WHEN contains(text, '|') THEN 'tables' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens,
  md5(coalesce(text, '')) AS text_md5 FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
{_AIMS},
c0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens AS weight, aim_source, aim_lang, aim_topic
  FROM cells JOIN a_source USING (source) JOIN a_lang USING (lang) JOIN a_topic USING (topic)),
{_rake_sql(mx.ROUNDS)},
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE {mx.KEEP} END AS probability FROM raked)
SELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability,
  CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_md5 || ':{mx.SEED}'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < probability AS sampled
FROM d JOIN p USING (source, lang, topic)
"""


@query("op7_mixing", OP7_SQL)
def op7(spark, sf_dir):
    rows = checkpointed(mx.described(table(spark, sf_dir, "documents")))
    found = mx.sample(rows, mx.plan_mix(rows))
    return found.select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled"
    )


@query("op5_line_dedup")
def op5(spark, sf_dir):
    found = ld.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_no", "first_doc_id", "first_line_no", "near", "removed")


@query("op8_license_scan")
def op8(spark, sf_dir):
    return ls.scan_documents(table(spark, sf_dir, "documents"))


@query("op1_suffix_dedup")
def op1(spark, sf_dir):
    return sd.removed_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _merkle_sql(levels: int) -> str:
    """The tree level by level: nodes of a group until one is left, then the groups; ``levels`` is more than any table here needs."""

    def climb(prefix: str, first: str) -> list[str]:
        parts, now = [], first
        for n in range(levels):
            up, total = f"{prefix}{n + 1}", f"(SELECT g, count(*) AS n FROM {now} GROUP BY 1)"
            parts.append(
                f"{up} AS MATERIALIZED (SELECT t.g, i // 8 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h"
                f" FROM {now} t JOIN {total} c ON t.g = c.g GROUP BY t.g, i // 8, n)"
            )
            parts.append(
                f"{up}s AS MATERIALIZED (SELECT a.g, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,"
                f" coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r, n > 1 AS live"
                f" FROM {now} a JOIN {now} b ON a.g = b.g AND a.i // 8 = b.i // 8 JOIN {total} c ON a.g = c.g GROUP BY a.g, a.i, n)"
            )
            now = up
        return parts

    ways = []
    for prefix, key, place in (("t", "g", "i"), ("r", "", "gi")):
        for n in range(levels):
            ways.append((f"{prefix}{n + 1}s", f"w.{key}" if key else "''", f"w.{place} // {8**n}"))
    folds, last = [], "w0"
    for n, (side, key, place) in enumerate(ways):
        now = f"w{n + 1}"
        folds.append(
            f"{now} AS (SELECT w.* EXCLUDE (proof, fold), CASE WHEN live THEN proof || l || r ELSE proof END AS proof,"
            f" CASE WHEN live THEN sha256(l || fold || r) ELSE fold END AS fold FROM {last} w JOIN {side} s ON s.g = {key} AND s.i = {place})"
        )
        last = now
    framed = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in mk.COLUMNS]
    low = [f.replace(" text", f" translate(text, '{mk.UPPER}', '{mk.LOWER}')") if c == "text" else f for c, f in zip(mk.COLUMNS, framed, strict=True)]
    crc = (
        "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),"
        " lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda z: CAST(-1 AS BIGINT)))))),"
        " lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    )
    return f"""
WITH d AS MATERIALIZED (SELECT coalesce('=' || lang, '') AS g, doc_id, sha256({" || ".join(framed)}) AS leaf,
  sha256({" || ".join(low)}) AS low, {crc} % 3 = 0 AS hit FROM documents),
t0 AS MATERIALIZED (SELECT g, doc_id, leaf AS h, CASE WHEN hit THEN low ELSE leaf END AS used,
  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{", ".join(climb("t", "t0"))},
r0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, g AS gg FROM t{levels}),
{", ".join(climb("r", "r0"))},
w0 AS (SELECT t.doc_id, t.g, t.i, r0.i AS gi, t.h AS leaf, r0.h AS subroot, (SELECT h FROM r{levels}) AS root, '' AS proof, t.used AS fold
  FROM t0 t JOIN r0 ON r0.gg = t.g),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM {last}
"""


@query("op12_merkle_manifest", _merkle_sql(7))
def op12(spark, sf_dir):
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = mk.manifest(table(spark, sf_dir, "documents"), hit)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op13_bpe_codec")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lexicon = lb.build_lexicon(docs, public_tokenizers.path("byte_bpe_50k.json"))
    found = lb.decode(lb.encode(docs, lexicon), lexicon)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _codes_sql(rounds: int) -> str:
    """Lloyd's rounds one after another over (vector, part, position) rows."""
    parts = []
    for n in range(rounds + 1):
        parts.append(
            f"d{n} AS MATERIALIZED (SELECT r, part, min(d * 16 + entry) AS m FROM (SELECT r, x.part, c.entry, sum((x.x - c.x) * (x.x - c.x)) AS d"
            f" FROM x JOIN c{n} c ON x.part = c.part AND x.p = c.p GROUP BY r, x.part, c.entry) GROUP BY r, part)"
        )
        if n < rounds:
            parts.append(
                f"c{n + 1} AS MATERIALIZED (SELECT part, entry, p, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT part, m % 16 AS entry, p,"
                f" CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x"
                f" FROM x JOIN d{n} USING (r, part) GROUP BY ALL) m USING (part, entry, p))"
            )
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS r, vec_id, label, e FROM (SELECT vec_id, label,
  list_transform(embedding, lambda x: CAST(floor({cc.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
x AS MATERIALIZED (SELECT r, (i - 1) // (len(e) // {cc.PARTS}) AS part, (i - 1) % (len(e) // {cc.PARTS}) AS p, e[i] AS x
  FROM (SELECT r, e, unnest(range(1, len(e) + 1)) AS i FROM v)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, p, x FROM x WHERE r <= {cc.ENTRIES}),
{", ".join(parts)},
f AS (SELECT r, string_agg(printf('%02x', CAST(m % 16 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM d{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, p)) FROM c{rounds}) AS codebooks_sha256 FROM v JOIN f USING (r)
"""


@query("op11_vector_codes", _codes_sql(cc.ROUNDS))
def op11(spark, sf_dir):
    found, codebooks = cc.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(cc.codebooks_digest(codebooks)).alias("codebooks_sha256"))
