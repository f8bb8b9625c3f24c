"""Registered queries of the corpus operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import (
    collocations,
    decontaminate,
    fill_middle,
    html_text,
    line_quality,
    neighbours,
    ngram_join,
    packing,
    passage_dedup,
    pii,
    repeat_dedup,
    toxicity,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


# Parts of the SQL: words of a text, and what is left of a text's numbered parts.
_WORDS = r"list_filter(string_split_regex({}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
_DOCS = "docs AS (SELECT doc_id::BIGINT AS doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)"

ORACLES["op1_ngram_jaccard_join"] = f"""
WITH RECURSIVE {_DOCS},
w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM docs),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n"""

ORACLES["op8_substring_dedup"] = f"""
WITH {_DOCS},
w AS (SELECT doc_id, {_WORDS.format("text")} AS words FROM docs),
v AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS first FROM v GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM v JOIN f USING (g) WHERE first < doc_id),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

ORACLES["op9_suffix_array_dedup"] = f"""
WITH {_DOCS},
h AS (SELECT doc_id, hex(encode(text)) AS h, (length(hex(encode(text))) // 2)::BIGINT AS n FROM docs),
v AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(1, n - 48)) AS i FROM h)),
f AS (SELECT g, min(doc_id) AS first FROM v GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM v JOIN f USING (g) WHERE first < doc_id),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans
         FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(range(1, n + 1)) AS p, h FROM h),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p - 1, 2), '' ORDER BY p) AS kept FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT h.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)"""

# Texts to pieces to words; n-grams of pieces, all occurrences; cuts of candidates after their first words.
ORACLES["op11_phrase_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, unnest(words) AS phrase FROM w
      UNION ALL SELECT lang, words[i] || ' ' || words[i + 1] FROM (SELECT lang, words, unnest(range(1, len(words))) AS i FROM w)
      UNION ALL SELECT lang, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]
                FROM (SELECT lang, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
f AS (SELECT lang, phrase, count(*) AS f, len(string_split(phrase, ' ')) AS size FROM g GROUP BY lang, phrase),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, size, string_split(phrase, ' ') AS words FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT c.*, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail FROM c, range(1, 3) t(k) WHERE k < size),
scored AS (SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, k, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
           FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE size = 3),
gone AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY lang, phrase),
kept AS (SELECT best.* FROM best LEFT JOIN gone USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""

ORACLES["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id::BIGINT AS doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS x, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS y,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
             WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:x], '') AS pre, array_to_string(units[x + 1:y], '') AS mid, array_to_string(units[y + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""

ORACLES["op13_url_reputation"] = r"""
WITH RECURSIVE rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
        ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
good AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
o AS (SELECT page_id, good FROM h JOIN good ON good.doc_id = try_cast(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1) AS BIGINT)),
b AS (SELECT host, count(*) AS pages, count(good) AS n, coalesce(sum(good), 0) AS good,
             rtrim(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS bare FROM h LEFT JOIN o USING (page_id) GROUP BY host),
l AS (SELECT *, CASE WHEN regexp_matches(bare, '^([0-9.]+|\[.*\]?)$') THEN [bare] ELSE string_split(bare, '.') END AS parts FROM b),
s AS (SELECT *, CASE WHEN len(parts) > 1 AND length(parts[-1]) = 2
             AND parts[-2] IN ('ac', 'co', 'com', 'edu', 'go', 'gov', 'gob', 'ne', 'net', 'nom', 'or', 'org') THEN 2 ELSE 1 END AS size FROM l),
hosts AS (SELECT host, n, good, array_to_string(parts[greatest(len(parts) - size, 1):], '.') AS domain,
                 array_to_string(parts[greatest(len(parts) - size + 1, 1):], '.') AS suffix FROM s),
total AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(good), 0) AS good FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY suffix),
s1 AS (SELECT suffix, s0.n, s0.good, (total.good - s0.good + 1)::DOUBLE / (total.n - s0.n + 2) AS p FROM s0, total),
sc AS (SELECT sum((good - n * p) ** 2 - n * p * (1 - p)) AS e, sum(n * (n - 1) * p * (1 - p)) AS m FROM s1 WHERE n > 0),
sw AS (SELECT CASE WHEN coalesce(m, 0) = 0 THEN 10.0 WHEN e / m > 0 THEN least(greatest(1 / (e / m) - 1, 0.5), 10000.0) ELSE 10000.0 END::DOUBLE AS w FROM sc),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY domain, suffix),
d1 AS (SELECT domain, d0.n, d0.good, (s1.good - d0.good + w * s1.p) / (s1.n - d0.n + w) AS p FROM d0 JOIN s1 USING (suffix), sw),
dc AS (SELECT sum((good - n * p) ** 2 - n * p * (1 - p)) AS e, sum(n * (n - 1) * p * (1 - p)) AS m FROM d1 WHERE n > 0),
dw AS (SELECT CASE WHEN coalesce(m, 0) = 0 THEN 10.0 WHEN e / m > 0 THEN least(greatest(1 / (e / m) - 1, 0.5), 10000.0) ELSE 10000.0 END::DOUBLE AS w FROM dc),
h1 AS (SELECT host, hosts.n, hosts.good, (d1.good - hosts.good + w * d1.p) / (d1.n - hosts.n + w) AS p FROM hosts JOIN d1 USING (domain), dw),
hc AS (SELECT sum((good - n * p) ** 2 - n * p * (1 - p)) AS e, sum(n * (n - 1) * p * (1 - p)) AS m FROM h1 WHERE n > 0),
hw AS (SELECT CASE WHEN coalesce(m, 0) = 0 THEN 10.0 WHEN e / m > 0 THEN least(greatest(1 / (e / m) - 1, 0.5), 10000.0) ELSE 10000.0 END::DOUBLE AS w FROM hc),
ab AS (SELECT host, good + w * p AS a, n - good + w * (1 - p) AS b FROM h1, hw),
bounds AS (SELECT host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM ab),
fit AS (SELECT page_id, rhost || rpath AS rule, rverdict FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) = 1)
SELECT h.page_id, h.host, h.path, rule, coalesce(rverdict, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict
FROM h JOIN bounds USING (host) LEFT JOIN fit USING (page_id)"""


@_register
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


@_register
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passage_dedup.cut_repeated_passages(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_register
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeat_dedup.cut_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_register
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@_register
def op5_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


@_register
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


@_register
def op10_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_register
def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_register
def op6_information_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.all_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@_register
def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_register
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


@_register
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored("output", "form"), 256).alias("restored_sha256"),
    )


@_register
def op13_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    rules = url_filter.rules_table(spark, [
        ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
        ("net", "/es/", "block"), ("net", "/fr/", "block"),
    ])
    judged = url_filter.judge(pages, rules, url_filter.outcomes_of_documents(pages, labels))
    return judged.select("page_id", "host", "path", "rule", "verdict")
