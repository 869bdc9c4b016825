"""Registered queries: text cleaning, language, scoring, routing."""

from pyspark.sql import functions as F

from tidelex.functions.wordlists import LANGUAGE_WORDS, LEMMA_EXCEPTIONS, LEMMA_RULES, LEXICON, STOP_WORDS
from tidelex.operators import langid as LI
from tidelex.operators import metrics as M
from tidelex.operators import results as RE
from tidelex.operators import scoring as SC
from tidelex.operators import text as TX
from tidelex.operators.state import batch_outcome
from tidelex.plans import views as V
from tidelex.plans.registry import query
from tidelex.session import materialize

B = TX.BLANK
WS = "' ' || chr(9) || chr(10) || chr(13)"
AT = "2024-03-01 00:00:00"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{B}]+', ' ', 'g'))"


def drop_sql(pattern: str):
    return lambda x: f"regexp_replace({x}, '{pattern}', '', 'g')"


URLS = drop_sql(f"(http|www)[^{B}]+")
EMAILS = drop_sql(f"[^{B}]*@[^{B}]*[{B}]?")
MENTIONS = drop_sql(f"@[{TX.WORD}]+")
TAGS = drop_sql(f"#[{TX.WORD}]+")


def basic_sql(x: str) -> str:
    return squeeze_sql(TAGS(MENTIONS(EMAILS(URLS(x)))))


def hits_sql(x: str, words) -> str:
    return f"len(list_filter({x}, lambda w: list_contains({sql_list(words)}, w)))"


def weight_sql(x: str, sign: int) -> str:
    parts = []
    for size in (1.0, 2.0, 3.0):
        words = [w for w, v in LEXICON.items() if v * sign == size]
        parts.append(f"{size} * {hits_sql(x, words)}")
    return "(" + " + ".join(parts) + ")::DOUBLE"


def prep_sql(source: str, keys: str, text: str) -> str:
    """CTEs ending in ``prep``: basic text, language, share, cleaned text."""
    hits = ", ".join(f"{hits_sql('words', ws)} AS h_{code}" for code, ws in LANGUAGE_WORDS.items())
    best = "greatest(h_en, h_de, h_fr, h_es)"
    return f"""basic AS (SELECT {keys}, {text} AS original, CASE WHEN trim({text}, {WS}) = '' THEN '' ELSE {basic_sql(text)} END AS b FROM {source}),
  hit AS (SELECT *, {hits} FROM (SELECT *, string_split(lower(b), ' ') AS words FROM basic)),
  lang AS (SELECT *, CASE WHEN {best} = 0 THEN 'unknown' WHEN h_en = {best} THEN 'en' WHEN h_de = {best} THEN 'de'
      WHEN h_fr = {best} THEN 'fr' ELSE 'es' END AS code,
      CASE WHEN {best} > 0 THEN {best} / (h_en + h_de + h_fr + h_es) END AS share FROM hit),
  prep AS (SELECT *, b = '' AND trim(original, {WS}) = '' AS blank, CASE WHEN code IN ('en', 'unknown') THEN array_to_string(list_filter(string_split(lower(b), ' '),
      lambda w: regexp_full_match(w, '\\p{{L}}+') AND NOT list_contains({sql_list(STOP_WORDS)}, w)), ' ')
      WHEN b = '' THEN '' ELSE lower(b) END AS cleaned FROM lang)"""


def softmax_sql(source: str, text: str) -> str:
    """CTEs ending in ``scored``: probabilities, confidence and label."""
    return f"""w AS (SELECT *, regexp_extract_all(lower({text}), '\\p{{L}}+') AS toks,
      sqrt(greatest(len(regexp_extract_all({text}, '[^{B}]+')), 1)) AS scale, trim({text}, {WS}) = '' AS empty FROM {source}),
  e AS (SELECT *, CASE WHEN empty THEN -10000 ELSE {weight_sql('toks', 1)} * 4 / scale END AS lp,
      CASE WHEN empty THEN -10000 ELSE {weight_sql('toks', -1)} * 4 / scale END AS ln FROM w),
  x AS (SELECT *, exp(lp - greatest(lp, ln, 1)) AS ep, exp(ln - greatest(lp, ln, 1)) AS en, exp(1 - greatest(lp, ln, 1)) AS eu FROM e),
  scored AS (SELECT *, ep / (ep + en + eu) AS pp, en / (ep + en + eu) AS pn, eu / (ep + en + eu) AS pu,
      greatest(ep, en, eu) / (ep + en + eu) AS conf,
      CASE WHEN ep >= en AND ep >= eu THEN 'positive' WHEN en >= eu THEN 'negative' ELSE 'neutral' END AS lab FROM x)"""


def docs(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def with_lang(spark, sf_dir):
    found = TX.language(TX.tokens_of(TX.basic_clean(F.col("text"))))
    return docs(spark, sf_dir).withColumn("_l", found).select(
        "doc_id", "lang", F.col("_l.code").alias("language"), F.col("_l.confidence").alias("language_confidence"))


#: What a cleaning step has to find, added to the documents, which hold little of it: every n-th gets a piece.
PIECES = ((2, "see https://site.example/a?b=1&c=#2 now"), (3, "www.site.example mail a.b@c.org,"), (4, "star ⭐😀 clock⏰ 🟢 ✂ arrow ➔"),
          (5, "hi @someone_1! and @é"), (7, "#topic_é #a#b ok"))
PIECES_SQL = "concat_ws(' ', text, " + ", ".join(f"CASE WHEN doc_id % {n} = 0 THEN '{piece}' END" for n, piece in PIECES) + ")"


def with_pieces(spark, sf_dir):
    pieces = [F.when(F.col("doc_id") % n == 0, F.lit(piece)) for n, piece in PIECES]
    return docs(spark, sf_dir).withColumn("text", F.concat_ws(" ", "text", *pieces))


def text_query(name: str, column, sql_expr: str):
    """The digest and length of a transformed text, and whether it differs from the given one, per document."""
    query(name, f"""SELECT doc_id, md5(t) AS digest, length(t) AS chars, t <> text AS changed
      FROM (SELECT doc_id, text, {sql_expr} AS t FROM (SELECT doc_id, {PIECES_SQL} AS text FROM documents))""")(
        lambda s, d: with_pieces(s, d).select("doc_id", "text", column(F.col("text")).alias("t")).select(
            "doc_id", F.md5("t").alias("digest"), F.length("t").alias("chars"), (F.col("t") != F.col("text")).alias("changed")))


def named_sql(text: str) -> str:
    """The emoji of the pieces by their names."""
    for sign, name in (("⭐", "white_medium_star"), ("😀", "grinning_face"), ("⏰", "alarm_clock"), ("🟢", "large_green_circle"),
                       ("✂", "black_scissors")):
        text = f"replace({text}, '{sign}', ' :{name}: ')"
    return text


# Assembly and resolution, over JSON payloads.

@query("txt1_text_assembly", f"""WITH {V.V_DOC_EVENTS} SELECT id, CASE WHEN text <> '' THEN md5(text) END AS digest FROM v_doc_events""")
def txt1(spark, sf_dir):
    return V.doc_events(spark, sf_dir).select("id", F.md5(TX.assemble_text(F.col("payload"))).alias("digest"))


@query("txt2_content_resolution", """SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE text END AS resolved FROM conversations""")
def txt2(spark, sf_dir):
    """User turns come as a JSON object, assistant turns as text, system turns as an object without text."""
    turns = V.table(spark, sf_dir, "conversations")
    content = (F.when(F.col("role") == "user", F.to_json(F.struct("text", "turn")))
               .when(F.col("role") == "system", F.to_json(F.struct("turn"))).otherwise(F.col("text")))
    payload = F.to_json(F.struct(F.col("turn"), F.lit(1).alias("text")))
    return turns.select("conv_id", "turn", TX.event_text(content, payload).alias("resolved"))


query("txt3_blank_check", f"""WITH {V.V_DOC_EVENTS} SELECT id, text = '' AS is_blank FROM v_doc_events""")(
    lambda s, d: V.doc_events(s, d).select("id", TX.is_blank(TX.assemble_text(F.col("payload"))).alias("is_blank")))
text_query("txt4_strip_urls", TX.strip_urls, URLS("text"))
text_query("txt5_strip_emails", TX.strip_emails, EMAILS("text"))
text_query("txt6_strip_mentions", TX.strip_mentions, MENTIONS("text"))
text_query("txt7_strip_hashtags", TX.strip_hashtags, TAGS("text"))
text_query("txt8_emoji_to_name", TX.emoji_to_name, named_sql("text"))
text_query("txt9_squeeze_blanks", lambda t: TX.single_spaces(TX.one_line(t)), squeeze_sql("text"))
query("txt4_strip_urls_pages", f"SELECT page_id, md5({URLS('html')}) AS digest FROM pages")(
    lambda s, d: V.table(s, d, "pages").select("page_id", F.md5(TX.strip_urls(F.col("html"))).alias("digest")))
PREP = "WITH " + prep_sql("documents", "doc_id, lang", "text")
query("txt10_language_id", PREP + " SELECT doc_id, code AS language, round(share, 6) AS language_confidence FROM lang")(
    lambda s, d: with_lang(s, d)
    .select("doc_id", "language", "language_confidence"))
query("txt10_language_agreement", PREP + " SELECT lang, code AS language, count(*) AS docs FROM lang GROUP BY 1, 2")(
    lambda s, d: with_lang(s, d)
    .groupBy("lang", "language").agg(F.count(F.lit(1)).alias("docs")))
query("txt11_language_gate", PREP + " SELECT doc_id, CASE WHEN code IN ('en', 'unknown') THEN 'result' ELSE 'skipped_language' END AS route FROM lang")(
    lambda s, d: TX.preprocess(docs(s, d), "text").select("doc_id", F.when(
        F.col("is_target_language"), F.lit("result")).otherwise(F.lit("skipped_language")).alias("route")))
query("txt12_token_filter", f"""SELECT doc_id, md5(array_to_string(list_filter(string_split({squeeze_sql('lower(text)')}, ' '),
    lambda w: regexp_full_match(w, '\\p{{L}}+') AND NOT list_contains({sql_list(STOP_WORDS)}, w)), ' ')) AS digest FROM documents""")(
    lambda s, d: docs(s, d).select("doc_id", F.md5(TX.filter_tokens(TX.single_spaces(TX.one_line(F.col("text"))))).alias("digest")))
query("txt13_lemmatizer_plugin", f"""SELECT doc_id, md5(array_to_string(list_filter(string_split({squeeze_sql('lower(text)')}, ' '),
    lambda w: regexp_full_match(w, '\\p{{L}}+') AND NOT list_contains({sql_list(STOP_WORDS)}, w)), ' ')) AS digest FROM documents""")(
    lambda s, d: docs(s, d).select("doc_id", TX.lemmas_by_model(F.col("text"), TX.WordFilter).alias("t"))
    .select("doc_id", F.md5("t").alias("digest")))
def lemma_sql(w: str) -> str:
    """The same exceptions and ordered rules as one CASE."""
    listed = " ".join(f"WHEN {w} = '{a}' THEN '{b}'" for a, b in LEMMA_EXCEPTIONS.items())
    rules = " ".join(f"WHEN ends_with({w}, '{end}') AND length({w}) >= {3 + cut - len(added)} THEN left({w}, length({w}) - {cut}) || '{added}'"
                     for end, cut, added in LEMMA_RULES)
    return f"CASE {listed} {rules} ELSE {w} END"


query("txt13_rule_lemmas", f"""SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split({squeeze_sql('lower(text)')}, ' '),
    lambda w: regexp_full_match(w, '\\p{{L}}+') AND NOT list_contains({sql_list(STOP_WORDS)}, w)), lambda w: {lemma_sql('w')}), ' ')) AS digest FROM documents""")(
    lambda s, d: docs(s, d).select("doc_id", F.md5(TX.rule_lemmas(TX.single_spaces(TX.one_line(F.col("text"))))).alias("digest")))


@query("txt10_language_profiles")
def txt10_profiles(spark, sf_dir):
    """Languages of all texts by triples fitted on four fifths of the labelled ones; the rest is held out."""
    rows = docs(spark, sf_dir)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    detect = LI.language_by_profile(LI.fit_profiles(rows.where(~held)))
    return rows.select("doc_id", "lang", held.alias("held_out"), detect(F.col("text")).alias("l")).select(
        "doc_id", "lang", "held_out", F.col("l.code").alias("language"), F.col("l.confidence").alias("language_confidence"))


query("txt14_preprocess", PREP + """ SELECT doc_id, md5(cleaned) AS digest, code AS detected_language_code,
  round(share, 6) AS detected_language_confidence, code IN ('en', 'unknown') AS is_target_language FROM prep""")(
    lambda s, d: TX.preprocess(docs(s, d), "text").select(
        "doc_id", F.md5("cleaned_text").alias("digest"), "detected_language_code", "detected_language_confidence",
        "is_target_language"))
query("txt15_preview", "SELECT doc_id, CASE WHEN length(text) > 100 THEN text[:100] || '...' ELSE text END AS preview FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", TX.preview(F.col("text")).alias("preview")))
query("txt16_length_pieces", """SELECT doc_id, CAST(i AS BIGINT) AS piece, md5(substr(text, i * 5000 + 1, 5000)) AS digest
  FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 5000) AS BIGINT)))) AS i FROM documents)""")(
    lambda s, d: docs(s, d).select("doc_id", F.posexplode(TX.length_pieces(F.col("text"))).alias("piece", "t"))
    .select("doc_id", "piece", F.md5("t").alias("digest")))

# Scoring

SOFT = "round(pp, 6) AS p_positive, round(pn, 6) AS p_negative, round(pu, 6) AS p_neutral, round(conf, 6) AS confidence, lab AS label"
PROBS = ["p_positive", "p_negative", "p_neutral", "confidence", "label"]


def keyword_sql(keys: str, source: str, empty: str, toks: str) -> str:
    """The sample model in SQL: softmax of the summed weights of each sign and 1."""
    return f"""k AS (SELECT {keys}, {empty} AS empty, {weight_sql('toks', 1)} AS lp, {weight_sql('toks', -1)} AS ln
      FROM (SELECT *, {toks} AS toks FROM {source})),
  x AS (SELECT *, CASE WHEN empty THEN 0 ELSE exp(lp - greatest(lp, ln, 1)) END AS ep,
      CASE WHEN empty THEN 0 ELSE exp(ln - greatest(lp, ln, 1)) END AS en,
      CASE WHEN empty THEN 1 ELSE exp(1 - greatest(lp, ln, 1)) END AS eu FROM k),
  scored AS (SELECT *, ep / (ep + en + eu) AS pp, en / (ep + en + eu) AS pn, eu / (ep + en + eu) AS pu,
      greatest(ep, en, eu) / (ep + en + eu) AS conf,
      CASE WHEN ep >= en AND ep >= eu THEN 'positive' WHEN en >= eu THEN 'negative' ELSE 'neutral' END AS lab FROM x)"""


query("sco1_classify_with_model", PREP + ", " + keyword_sql("doc_id", "prep", "cleaned = ''", "string_split(cleaned, ' ')")
      + f" SELECT doc_id, {SOFT} FROM scored")(lambda s, d: SC.classify_with_model(
    TX.preprocess(docs(s, d), "text").select("doc_id", "cleaned_text"), "cleaned_text", SC.KeywordScorer)
    .select("doc_id", *PROBS))
query("sco3_scorer_failure", PREP + ", " + keyword_sql("doc_id", "prep", "cleaned = ''", "string_split(cleaned, ' ')")
      + """ SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE lab END AS label,
  CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE round(conf, 6) END AS confidence, doc_id % 3 = 0 AS failed FROM scored""")(
    lambda s, d: SC.bulk_analyze(TX.preprocess(docs(s, d), "text").select("doc_id", F.when(
        F.col("doc_id") % 3 == 0, F.lit(SC.BROKEN)).otherwise(F.col("cleaned_text")).alias("t")), "t", make_scorer=SC.BreakingScorer)
    .select("doc_id", "label", "confidence", (F.col("label") == "error").alias("failed")))
query("sco2_blank_default", f"""WITH {V.V_DOC_EVENTS}, {softmax_sql('v_doc_events', 'text')} SELECT id, {SOFT} FROM scored WHERE empty""")(
    lambda s, d: SC.classify(V.doc_events(s, d).select("id", F.coalesce(
        TX.assemble_text(F.col("payload")), F.lit("")).alias("t")), "t").where(TX.is_blank(F.col("t"))).select("id", *PROBS))
query("sco4_softmax", f"WITH {softmax_sql('documents', 'text')} SELECT doc_id, {SOFT} FROM scored")(
    lambda s, d: SC.classify(docs(s, d), "text").select("doc_id", *PROBS))
query("sco5_lexicon_compound", f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS toks,
    len(regexp_extract_all(text, '[^{B}]+')) AS n FROM documents),
  s AS (SELECT doc_id, n, {weight_sql('toks', 1)} AS p, {weight_sql('toks', -1)} AS q FROM t),
  c AS (SELECT *, (p - q) / sqrt((p - q) * (p - q) + 15) AS c FROM s)
  SELECT doc_id, round(c, 6) AS compound, round(p / (p + q + n), 6) AS pos_share, round(q / (p + q + n), 6) AS neg_share,
    round(n / (p + q + n), 6) AS neu_share,
    CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS compound_label FROM c""")(
    lambda s, d: SC.with_compound(docs(s, d), "text").select(
        "doc_id", "compound", "pos_share", "neg_share", "neu_share", "compound_label"))
query("sco6_bulk_analyze", "WITH " + keyword_sql("conv_id, turn", "conversations", f"trim(text, {WS}) = ''",
      f"string_split_regex(lower(text), '[{B}]+')") + f" SELECT conv_id, turn, {SOFT}, 0.0::DOUBLE AS p_error FROM scored")(lambda s, d: SC.bulk_analyze(
    V.table(s, d, "conversations").select("conv_id", "turn", "text"), "text").select(
        "conv_id", "turn", *PROBS, "p_error"))
ANALYZE = PREP + ", pick AS (SELECT *, CASE WHEN cleaned = '' THEN original ELSE cleaned END AS s FROM prep), " + softmax_sql("pick", "s")
query("sco7_single_analyze", ANALYZE + f" SELECT doc_id, code AS detected_language_code, {SOFT} FROM scored")(
    lambda s, d: SC.analyze_text(docs(s, d), "text").select("doc_id", "detected_language_code", *PROBS))

# Routing

ROUTED = f"WITH {V.V_DOC_EVENTS}, " + prep_sql("v_doc_events", "id, source, source_id, occurred_at", "text") + ", " + softmax_sql("prep", "cleaned")
ROUTE = "CASE WHEN blank THEN 'dead_letter' WHEN code NOT IN ('en', 'unknown') THEN 'skipped_language' ELSE 'result' END"


def routing(spark, sf_dir):
    return RE.route_events(V.doc_events(spark, sf_dir))


def routed(spark, sf_dir):
    """Routed events, written out once: a filter on the route must not repeat the work above it."""
    return materialize(routing(spark, sf_dir))


query("res1_result_rows", ROUTED + f""" SELECT id AS event_id, occurred_at, source, source_id, round(conf, 6) AS sentiment_score,
  lab AS sentiment_label, round(conf, 6) AS confidence, TIMESTAMP '{AT}' AS processed_at, 'lexicon-1' AS model_version,
  md5(original) AS digest, round(pp - pn, 6) AS signed_score FROM scored WHERE {ROUTE} = 'result'""")(
    lambda s, d: RE.result_rows(routed(s, d), AT).withColumn("digest", F.md5("raw_text")).drop(
        "id", "sentiment_scores_json", "raw_text"))
query("res2_dead_letters", ROUTED + f""" SELECT CAST(id AS VARCHAR) AS event_id, occurred_at, source, source_id,
  '{RE.STAGE_INPUT}' AS processing_component, '{RE.BLANK_MESSAGE}' AS error_msg, TIMESTAMP '{AT}' AS failed_at
  FROM scored WHERE {ROUTE} = 'dead_letter'""")(
    lambda s, d: RE.dead_letters(routed(s, d), AT).drop("event_payload"))
query("res3_event_routes", ROUTED + f""" SELECT {ROUTE} AS route, source, count(*) AS events,
  coalesce(round(avg(conf) FILTER ({ROUTE} = 'result'), 6), 0) AS mean_score FROM scored GROUP BY 1, 2""")(
    lambda s, d: routing(s, d).groupBy("route", "source").agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.avg(
        F.when(F.col("route") == "result", F.col("confidence"))), F.lit(0.0)).alias("mean_score")))
query("clm5_batch_outcome", ROUTED + f""" SELECT count(*) AS attempted, count(*) FILTER ({ROUTE} <> 'dead_letter') AS succeeded,
  count(*) FILTER ({ROUTE} = 'dead_letter') AS failed FROM scored""")(
    lambda s, d: batch_outcome(routing(s, d)))
query("eva1_scoring_quality", f"""WITH {softmax_sql('documents', 'text')},
  p AS (SELECT CASE WHEN lab = 'negative' THEN 1 ELSE 0 END AS predicted, l.toxic AS actual FROM scored JOIN labels l USING (doc_id)),
  k AS (SELECT unnest([0, 1]) AS label)
  SELECT CAST(label AS BIGINT) AS label, tp AS true_positive, pn AS predicted_n, an AS actual_n, round(tp / nullif(pn, 0), 6) AS "precision",
    round(tp / nullif(an, 0), 6) AS recall, round(2 * tp / (pn + an), 6) AS f1
  FROM (SELECT label, count(*) FILTER (predicted = label AND actual = label) AS tp, count(*) FILTER (predicted = label) AS pn,
    count(*) FILTER (actual = label) AS an FROM k, p GROUP BY 1)""")(
    lambda s, d: SC.confusion(SC.classify(docs(s, d), "text").join(V.table(s, d, "labels"), "doc_id").select(
        (F.col("label") == "negative").cast("int").alias("predicted"), F.col("toxic").cast("int").alias("actual")),
        "predicted", "actual"))
query("doc5_word_counts", PREP + """ SELECT word, count(*) AS n FROM (SELECT unnest(string_split(cleaned, ' ')) AS word
  FROM prep) WHERE word <> '' GROUP BY 1""")(
    lambda s, d: M.word_counts(TX.preprocess(docs(s, d), "text").withColumn("words", F.split("cleaned_text", " ")), "words")
    .where("word <> ''"))
