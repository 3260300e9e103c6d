"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octaspark.llm import bpe, decontam, html, langid, media, minhash, quality, resample, secrets, spelling, substring, tokens, toxicity
from octaspark.llm.common import fold, read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def held_out(modulus: int, held: int):
    return F.coalesce(fold("doc_id", modulus) == held, F.lit(False))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_documents(read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, counts=True).select("doc_id", "n_sentences", "n_removed", "words_removed", "text")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern())


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.training_rows(docs, read(spark, sf_dir, "labels"), "toxic"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted", *toxicity.PATTERNS)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train_on_folds(docs))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "margin", "ambiguous")


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted", "n_passages", "top_passage")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents"), secrets.train()))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_media_columns,
        op2_substring_dedup,
        op3_byte_bpe,
        op4_html_extraction,
        op5_toxicity,
        op6_decontamination,
        op7_language_id,
        op8_minhash_forest,
        op9_quality,
        op10_token_counts,
        op11_importance_resampling,
        op12_secret_scan,
        op13_spelling_variants,
    )
}
#: All pairs that share a shingle, counted; their links; what each document reaches.
NEAR_DUPLICATES_SQL = f"""WITH RECURSIVE wd AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM wd WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
co AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
ln AS (SELECT a, b FROM co JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ed AS (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln),
re AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT re.id, ed.b FROM re JOIN ed ON re.r = ed.a),
cm AS (SELECT id, min(r) AS component_id FROM re GROUP BY 1)
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM cm LEFT JOIN sz ON sz.doc_id = id"""
#: crc32 of the UTF-8 bytes of ``word`` in ``dist``: the usual table, made by its rule, applied byte by byte.
_CRC32_SQL = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda k: CAST(k AS BIGINT))), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hx AS (SELECT word, hex(encode(word)) AS x FROM dist),
bt AS (SELECT word, list_transform(range(len(x) // 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT)) AS bytes FROM hx),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295::BIGINT) AS h FROM bt, tab)"""
_LOWERED = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
_RESAMPLE_WORDS = f"list_filter(string_split_regex({_LOWERED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
RESAMPLING_SQL = f"""WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {_RESAMPLE_WORDS} AS w FROM documents),
bw AS (SELECT {_RESAMPLE_WORDS} AS w FROM benchmark),
ds AS (SELECT r, unnest(w) AS word FROM dw), bs AS (SELECT unnest(w) AS word FROM bw),
dist AS (SELECT word FROM ds UNION SELECT word FROM bs),
{_CRC32_SQL},
bu AS (SELECT word, h % {resample.BUCKETS} AS k FROM crc),
sc AS (SELECT k, count(*) AS n FROM ds JOIN bu USING (word) GROUP BY k), tc AS (SELECT k, count(*) AS n FROM bs JOIN bu USING (word) GROUP BY k),
tot AS (SELECT (SELECT count(*) FROM ds) AS sa, (SELECT count(*) FROM bs) AS ta),
ga AS (SELECT sc.k, CAST(floor(1000 * ln((CAST(coalesce(tc.n, 0) AS DOUBLE) + 1) * (sa + {resample.BUCKETS}) / ((CAST(sc.n AS DOUBLE) + 1) * (ta + {resample.BUCKETS})))) AS BIGINT) AS g FROM sc LEFT JOIN tc ON sc.k = tc.k, tot),
we AS (SELECT r, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM ds JOIN bu USING (word) JOIN ga USING (k) GROUP BY r),
hh AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, substr(sha256('{resample.SEED}:' || doc_id), 1, 8) AS x FROM dw),
hv AS (SELECT *, list_reduce(list_transform(range(8), lambda i: CAST(instr('0123456789abcdef', x[i + 1]) - 1 AS BIGINT)), lambda a, b: 16 * a + b) AS h FROM hh),
so AS (SELECT hv.r, doc_id, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM hv LEFT JOIN we ON hv.r = we.r),
rk AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, count(*) OVER () AS n FROM so WHERE n_features >= {resample.LEAST_WORDS} AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rank <= n * {resample.PER_CENT} // 100 THEN rank END AS BIGINT) AS rank FROM so LEFT JOIN rk ON so.r = rk.r"""
#: Neighbours by words without one letter: equal to another word, or to another without the letter at the same place.
SPELLING_SQL = f"""WITH RECURSIVE ru AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[A-Za-z\u00C0-\u00FF]+') AS w FROM documents),
oc AS (SELECT doc_id, unnest(w) AS run FROM ru),
di AS (SELECT doc_id, run, count(*) AS c FROM oc GROUP BY 1, 2),
dist AS (SELECT DISTINCT doc_id || ':' || run AS word FROM di WHERE doc_id IS NOT NULL AND length(run) >= {spelling.LEAST_LETTERS}),
{_CRC32_SQL},
mu AS (SELECT CASE WHEN h % {spelling.MODULUS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM di LEFT JOIN crc ON crc.word = doc_id || ':' || run),
wn AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM mu WHERE length(word) >= {spelling.LEAST_LETTERS} GROUP BY 1 HAVING sum(c) >= {spelling.LEAST_COUNT}),
cu AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM wn)),
pr AS (SELECT a.word AS w, b.word AS o, b.n AS m FROM cu a JOIN cu b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cu a JOIN wn b ON a.cut = b.word UNION SELECT b.word, a.word, a.n FROM cu a JOIN wn b ON a.cut = b.word),
be AS (SELECT w, o, m, count(*) OVER (PARTITION BY w) AS n_near, row_number() OVER (PARTITION BY w ORDER BY m DESC, o) AS k FROM pr),
fo AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.RATIO} * n THEN o END AS form, CASE WHEN m >= {spelling.RATIO} * n THEN m END AS form_n FROM wn LEFT JOIN be ON w = word AND k = 1),
ch AS (SELECT word, word AS form, 0 AS steps FROM fo UNION ALL SELECT ch.word, fo.form, steps + 1 FROM ch JOIN fo ON fo.word = ch.form WHERE fo.form IS NOT NULL),
ro AS (SELECT word, arg_max(form, steps) AS root FROM ch GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM fo JOIN ro USING (word)"""
ORACLE: dict[str, str] = {"op8_minhash_forest": NEAR_DUPLICATES_SQL, "op11_importance_resampling": RESAMPLING_SQL, "op13_spelling_variants": SPELLING_SQL}
