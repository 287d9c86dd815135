"""The registered queries of this subpackage and their SQL."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.llm import (
    collision_search,
    context_tree,
    exact_copies,
    language,
    licences,
    mixing,
    periodic_runs,
    personal,
    pieces,
    secret_ledger,
    shingle_join,
    small_worlds,
    target_resampling,
)
from newsweave.session import scratch_path, write_out

TOKENIZER = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, through a ledger that starts empty."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = scratch_path(spark, "secret-ledger")
    secret_ledger.extend_ledger(documents, ledger)
    return secret_ledger.scan_digest(secret_ledger.findings(documents, ledger))


def op2_sentence_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document by its licence sentences."""
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return context_tree.context_tree_scores(_table(spark, sf_dir, "documents"))


def op4_exact_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    model = pieces.read_model(public_tokenizers.path(TOKENIZER))
    return pieces.encoding_digest(_table(spark, sf_dir, "documents"), model)


def op5_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language.predicted_languages(_table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document."""
    documents = _table(spark, sf_dir, "documents")
    sized, _ = write_out(
        documents.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sized"
    )
    return mixing.with_copies(sized, mixing.source_targets(sized)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op7_count_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share nine tenths of their three-word shingles."""
    documents = _table(spark, sf_dir, "documents")
    return shingle_join.similar_documents(documents, words=3, num=90, den=100)


def op8_small_worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return small_worlds.similar_vectors(_table(spark, sf_dir, "embeddings"))


def op9_collision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every twentieth."""
    embeddings = _table(spark, sf_dir, "embeddings")
    return collision_search.search(embeddings, F.col("vec_id") % 20 == 0)


def op10_anchored_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal.personal_digest(personal.find_personal(documents))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document."""
    return periodic_runs.run_digest(_table(spark, sf_dir, "documents"))


def op12_digest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of every document's exact copies stays."""
    return exact_copies.exact_copies(_table(spark, sf_dir, "documents"))


def op13_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against the benchmark."""
    return target_resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_secret_ledger,
        op2_sentence_licences,
        op3_context_tree,
        op4_exact_pieces,
        op5_output_codes,
        op6_source_mix,
        op7_count_tree,
        op8_small_worlds,
        op9_collision_counts,
        op10_anchored_personal,
        op11_periodic_runs,
        op12_digest_merge,
        op13_crc_resampling,
    )
}


# Positions of a pattern's matches, from the pieces between them.
_SPANS = """
SELECT doc_id, {place} AS place, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
    'start': list_sum(list_transform(g[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
    'size': length(m[i]), 'value': v[i]}})) AS s
FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v,
             string_split_regex(t, '{pattern}') AS g FROM d)"""
_SECRETS = [
    ("assign", """((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", 0, 1),
    ("login", "://[^\\s:/?#@]+:[^\\s:/?#@]+@", 0, 1),
]
_OP1 = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + " UNION ALL ".join(
        "SELECT doc_id, place, kind, s.start AS a, s.start + s.size AS b FROM ("
        + _SPANS.format(place=place, kind=kind, pattern=pattern, group=group)
        + f") WHERE length(s.value) >= {least}"
        for place, (kind, pattern, group, least) in enumerate(_SECRETS)
    )
    + """), l AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
    count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) FILTER (place < 3) AS base,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
    coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN l USING (doc_id)"""
)

_KNOWN, _NAMED = (
    "MAP {" + ", ".join(f"'{known}': '{name}'" for name, listed in table.items() for known in listed) + "}"
    for table in (licences.SENTENCES, licences.NAMES)
)
_PLAIN = "lower(text)"
for _pattern, _instead in licences.STEPS:
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', '{_instead.replace('$', chr(92))}', 'g')"
# Every blank and end stands twice here, so that what is found can take one on either side.
_BLANK = "(?:  |//)"
_FOUND = (
    "[|/](?:" + licences.known_pattern([k for listed in licences.SENTENCES.values() for k in listed], _BLANK) + ")[|/]"
    "|[|/ ]" + licences.NOTICE.replace(" ", _BLANK)
    + "(?:" + licences.known_pattern([k for listed in licences.NAMES.values() for k in listed], _BLANK) + ")[|/ ]"
)
_TAKEN = "line"
for _licence, _parts in licences.RULES:
    _TAKEN = f"replace({_TAKEN}, '{''.join(f'|{part}|' for part in _parts)}', '|={_licence}|')"
_OP2 = f"""
WITH p AS (SELECT doc_id, regexp_replace('|' || trim({_PLAIN}) || '|', '([|/ ])', '\\1\\1', 'g') AS plain
      FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, string_split_regex(plain, '{_FOUND}') AS gaps,
        list_transform(regexp_extract_all(plain, '{_FOUND}'), lambda x: trim(regexp_replace(x, '[|/ ]+', ' ', 'g'))) AS known
      FROM p),
n AS (SELECT doc_id, gaps, list_transform(known, lambda k:
        coalesce({_KNOWN}[k], {_NAMED}[regexp_replace(k, '^{licences.NOTICE}', '')])) AS names FROM f),
l AS (SELECT doc_id, '|' || array_to_string(flatten(list_transform(range(1, len(gaps) + 1), lambda i: list_filter([
        CASE WHEN regexp_matches(gaps[i], '[a-z0-9]') THEN '-' END, names[i]], lambda x: x IS NOT NULL))), '||') || '|' AS line,
        len(names) AS n_known, array_to_string(names, ',') AS sentence_ids FROM n),
t AS (SELECT doc_id, n_known, sentence_ids, {_TAKEN} AS taken FROM l)
SELECT documents.doc_id, coalesce(array_to_string(regexp_extract_all(taken, '\\|=([^|]+)\\|', 1), ','), '') AS licences,
    coalesce(len(regexp_extract_all(taken, '\\|=([^|]+)\\|', 1)), 0) AS n_licences, coalesce(n_known, 0) AS n_known,
    coalesce(len(regexp_extract_all(taken, '\\|([^|=-][^|]*)\\|', 1)), 0) AS n_left,
    coalesce(sentence_ids, '') AS sentence_ids
FROM documents LEFT JOIN t USING (doc_id)"""

# A source is at its bound if it is when all that fill up before it are.
_OP6 = f"""
WITH sized AS (SELECT doc_id, source,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
        WHEN 0 THEN {mixing.WEIGHTS[0]} WHEN 1 THEN {mixing.WEIGHTS[1]} ELSE {mixing.WEIGHTS[2]} END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST) AS k FROM w),
c AS (SELECT *, coalesce(sum(source_size * 3) OVER before, 0)::BIGINT AS held,
        coalesce(sum(weight) OVER before, 0)::BIGINT AS taken,
        (sum(source_size) OVER ())::BIGINT AS words, (sum(weight) OVER ())::BIGINT AS shares
      FROM o WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, source_size * 3 <= weight * ((words - held)::DOUBLE / (shares - taken)) AS at_bound FROM c),
e AS (SELECT max(words) AS words, max(shares) AS shares, coalesce(sum(source_size * 3) FILTER (at_bound), 0)::BIGINT AS held,
        coalesce(sum(weight) FILTER (at_bound), 0)::BIGINT AS taken FROM b),
t AS (SELECT source, source_size, CASE WHEN at_bound THEN (source_size * 3)::DOUBLE
        ELSE weight * ((e.words - e.held)::DOUBLE / (e.shares - e.taken)) END AS target FROM b, e),
r AS (SELECT doc_id, size, source_size, target,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {mixing.DRAWS}::DOUBLE AS draw
      FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS taken FROM r"""

_OP7 = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b
      ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""

_OP12 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)"""

# CRC-32 byte by byte, of each distinct word once.
_OP13 = """
WITH RECURSIVE k(b, v, step) AS (SELECT range, range, 0 FROM range(256) UNION ALL
    SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM k WHERE step < 8),
c AS (SELECT list(v ORDER BY b) AS l FROM k WHERE step = 8),
f AS (SELECT side, doc_id, unnest(w) AS word FROM (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM (SELECT 's' AS side, doc_id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark))),
h AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        range(1, octet_length(encode(word))::BIGINT + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT)),
        lambda a, x: xor(l[xor(a & 255, x) + 1], a >> 8))) % 10000 AS bucket FROM (SELECT DISTINCT word FROM f), c),
n AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM f JOIN h USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM n) + 10000))::DOUBLE
        / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))::DOUBLE))::BIGINT AS gain FROM n),
w AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
      FROM f JOIN h USING (word) JOIN g USING (bucket) WHERE side = 's' GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT
        AS score FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
        count(*) FILTER (n_features >= 20) OVER () AS eligible FROM r)
SELECT doc_id, n_features, weight, score,
    CASE WHEN n_features >= 20 AND place <= eligible * 10 // 100 THEN place END AS rank FROM o"""

ORACLE: dict[str, str] = {
    "op1_secret_ledger": _OP1,
    "op2_sentence_licences": _OP2,
    "op6_source_mix": _OP6,
    "op7_count_tree": _OP7,
    "op12_digest_merge": _OP12,
    "op13_crc_resampling": _OP13,
}
