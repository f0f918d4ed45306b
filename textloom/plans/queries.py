"""One query for each operator of the library, and how DuckDB says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import compare, dates, law, location, parties, terms, text, titles
from textloom.operators import calibration, evaluation, learning, measure, scope, sheet, windows
from textloom.plans.contracts import FACTS_SQL, LONG_FACTS_SQL, annotated, contracts, long_contracts

CUES = ["and", "able", "tion", "ther", "theand", "idiot", "worthless", "clown"]
QUERIES, ORACLES = {}, {}


def query(oracle: str):
    """Registers a query with the SQL that says the same."""

    def register(f):
        casts = ", ".join(f'cast("{c}" as {kind}) as "{c}"' for kind, columns in CASTS.get(f.__name__, {}).items() for c in columns)
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"select * replace ({casts}) from ({oracle})" if casts else oracle
        return f

    return register


#: DuckDB counts conditions in 128 bits and numbers rows in 64; these columns are cast to the query's types.
CASTS = {
    "rule_accuracy": {"bigint": ["right"]},
    "rule_failures": {"int": ["place"]},
    "sheet_accuracy": {"bigint": ["perfect", "eighty"]},
    "accuracy_by_group": {"bigint": ["right"]},
    "majority_floor": {"bigint": ["yes", "no", "total", "confirmations"]},
    "floor_report": {"bigint": ["si", "no", "total", "human_confirmations"]},
    "floor_summary": {"bigint": ["skewed", "balanced"]},
    "cue_terms_top40": {"int": ["place"]},
    "threshold_sweep": {"int": ["step"], "bigint": ["true_pos", "true_neg"]},
    "confusion_metrics": {"bigint": ["n", "positives"]},
    "detector_summary": {"bigint": ["above_55"]},
    "bucket_counts": {"bigint": ["n", "alone"]},
    "sheet_footer": {"bigint": ["closed", "to_review", "pending"]},
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.format_string("doc-%09d", "doc_id").alias("name"), "text", "source", "lang")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, category, label) for two clauses: junk and toxic."""
    raw = _read(spark, sf_dir, "labels").select(F.format_string("doc-%09d", "doc_id").alias("name"), (F.col("quality") == 0).alias("junk"), (F.col("toxic") == 1).alias("toxic"))
    return raw.unpivot(["name"], ["junk", "toxic"], "category", "label")


# ---- text functions ----

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_WORDS_SQL = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z][a-z\\-'']{{2,}}'), lambda x: not list_contains(stop, x)))"
_DOCS_SQL = f"""base as (select doc_id, printf('doc-%09d', doc_id) as name, text, source, lang, [{_STOP}] as stop from documents),
labelled as (select printf('doc-%09d', doc_id) as name, 'junk' as category, quality = 0 as label from labels union all select printf('doc-%09d', doc_id), 'toxic', toxic = 1 from labels)"""


@query(
    """select doc_id, cast(len(string_split_regex(text, '\\s+')) as bigint) as pieces, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 60) as needle,
    trim(regexp_replace(lower(source || ' (No.)! ' || lang), '[^\\p{L}\\p{N} ]', '', 'g')) as key, source || '.v1' as stem from documents"""
)
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squeezing, needles, category keys, file stems."""
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.size(F.split("text", r"\s+")).cast("bigint").alias("pieces"), text.needle(F.col("text")).alias("needle"), text.key_of(F.concat("source", F.lit(" (No.)! "), "lang")).alias("key"), text.stem(F.concat("source", F.lit(".v1.PDF"))).alias("stem"))


@query(f"with {_DOCS_SQL} select doc_id, cast(len({_WORDS_SQL.format('text')}) as bigint) as words from base")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1."""
    return _docs(spark, sf_dir).select("doc_id", F.size(text.word_set(F.col("text"))).cast("bigint").alias("words"))


@query("select doc_id, unnest(range(0, greatest(1, length(text)), 800)) as start, length(substr(text, cast(unnest(range(0, greatest(1, length(text)), 800)) + 1 as int), 1600)) as chars from documents")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2."""
    d = _docs(spark, sf_dir).select("doc_id", "text", F.explode(text.window_starts(F.col("text"))).alias("start"))
    return d.select("doc_id", F.col("start").cast("bigint").alias("start"), F.length(F.substring("text", F.col("start") + 1, F.lit(text.WINDOW))).cast("bigint").alias("chars"))


_BEST_SQL = f"""with {_DOCS_SQL}, cut as (
  select doc_id, stop, text, unnest(range(0, greatest(1, length(text)), 800)) as start from base),
hits as (select doc_id, start, len(list_intersect({_WORDS_SQL.format('substr(text, cast(start + 1 as int), 1600)')}, [{', '.join(f"'{c}'" for c in CUES)}])) as n from cut),
ranked as (select *, row_number() over (partition by doc_id order by n desc, start) as r from hits)
select doc_id, cast(n as double) / {len(CUES)} as score, case when n > 0 then start end as start from ranked where r = 1"""


@query(_BEST_SQL)
def window_best_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 to R3, A4, A5, J10."""
    cues = spark.createDataFrame([("fixed", CUES)], "category string, cues array<string>")
    return windows.score(_docs(spark, sf_dir), cues).select("doc_id", "score", F.col("start").cast("bigint").alias("start"))


# ---- rules over contracts with known answers ----


@query(f"with {FACTS_SQL} select k, case when dated then mdy end as date from facts")
def extract_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2 over whole texts."""
    return contracts(spark, sf_dir).select("k", dates.extract_date(F.col("text")).alias("date"))


@query(f"with {FACTS_SQL} select k, case when dated then mdy end as agreement_date, case when dated then mdy end as effective_date from facts")
def date_in_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, L2, L3, L6, L7, U6."""
    t = F.col("text")
    return contracts(spark, sf_dir).select("k", dates.rule_date(location.fragments("agreement date", t)).alias("agreement_date"), dates.rule_date(location.fragments("effective date", t)).alias("effective_date"))


@query(f"with {FACTS_SQL} select k, years || ' years' as first_term, notice_days || ' day' || case when notice_days = 1 then '' else 's' end as near_notice, cast(notice_days as bigint) as days from facts")
def term_first_and_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, F5, F15, J11."""
    t = F.col("text")
    near = terms.term_near(t, ("day",), terms.NOTICE_WORDS)
    return contracts(spark, sf_dir).select("k", terms.term_in(t, "year").alias("first_term"), near.alias("near_notice")).withColumn("days", terms.to_days(F.col("near_notice")))


@query(f"with {FACTS_SQL} select k, '1 year' as renewal, notice_days || ' day' || case when notice_days = 1 then '' else 's' end as notice from facts")
def renewal_and_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, F7, L1."""
    t = F.col("text")
    return contracts(spark, sf_dir).select("k", terms.rule_renewal(location.fragments("renewal term", t)).alias("renewal"), terms.rule_notice(location.fragments("notice period to terminate renewal", t)).alias("notice"))


@query(
    f"""with {FACTS_SQL} select k, case when dated then month(d) || '/' || case when month(d) = 2 and day(d) = 29 and (year(d) + years) % 4 <> 0 then 28 else day(d) end
    || '/' || lpad(cast((year(d) + years) % 100 as varchar), 2, '0') end as expires from facts"""
)
def expiration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 from the located effective date."""
    t = F.col("text")
    return contracts(spark, sf_dir).select("k", text.let(dates.rule_date(location.effective_date(t)), lambda e: terms.rule_expiration(F.array(t), e)).alias("expires"))


@query(
    f"""with {FACTS_SQL} select k, case when lawful then place end as law, 'Delaware' as naive from facts"""
)
def governing_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule over located fragments; the naive rule takes the seller's state."""
    t = F.col("text")
    return contracts(spark, sf_dir).select("k", law.rule_law(location.fragments("governing law", t)).alias("law"), law.naive_law(t).alias("naive"))


@query(
    f"""with {FACTS_SQL} select k, kind || ' SUPPLY AGREEMENT' as title, case when k % 11 = 0 then 'EXHIBIT 10.4' else kind || ' SUPPLY AGREEMENT' end as naive, case when k % 11 = 0 then null else kind || ' SUPPLY AGREEMENT' end as plausible from facts"""
)
def title_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, F10, F16, L4, T1, T8."""
    t = F.col("text")
    first = text.let(titles.naive_title(t), lambda x: F.when(~x.startswith("EXHIBIT"), titles.plausible_title(x)))
    return contracts(spark, sf_dir).select("k", titles.rule_title(location.fragments("document name", t)).alias("title"), titles.naive_title(t).alias("naive"), first.alias("plausible"))


@query(
    """with said as (select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) as t, coalesce(strpos(html, '<') > 0, false) as markup from pages)
    select page_id, markup, case when length(t) between 8 and 200 and not regexp_matches(t, '[<>]') and length(regexp_replace(t, '[^\\p{L}\\s]', '', 'g')) / length(t) >= 0.6 and regexp_matches(t, '[A-Za-z]{3,}') then t end as title,
    cast(null as varchar) as line from said"""
)
def title_of_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 and F16 on whole pages: the page's own title if it can be one; a line of markup never is."""
    p, html = _read(spark, sf_dir, "pages"), F.coalesce("html", F.lit(""))
    return p.select("page_id", F.contains(html, F.lit("<")).alias("markup"), titles.plausible_title(text.extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), titles.plausible_title(F.when(F.contains(html, F.lit("<")), html)).alias("line"))


@query(f"""with {FACTS_SQL} select k, 'Buyer ' || c || ' Trading Co ("Buyer"); Norvex Supply LLC ("Seller")' as parties, 'Buyer ' || c as stripped from facts""")
def parties_from_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, F14, L5, T7."""
    d = contracts(spark, sf_dir)
    bare = parties.strip_description(F.concat(F.lit("Buyer "), "c", F.lit(", a Delaware limited partnership")))
    return d.select("k", parties.parties_in(location.fragments("parties", F.col("text"))).alias("parties"), bare.alias("stripped"))


@query("select c_custkey, c_name || '; ' || c_mktsegment || ' Ltd' as parties from customer")
def parties_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name once."""
    # The customers' file is one task: spread it before.
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition(2 * spark.sparkContext.defaultParallelism, "c_custkey")
    listed = F.array("c_name", F.concat(F.lit(" "), "c_name", F.lit(" ")), F.upper("c_name"), F.concat("c_mktsegment", F.lit(" Ltd")), F.lit("x."))
    return c.select("c_custkey", parties.rule_parties(listed).alias("parties"))


@query(
    f"""with {FACTS_SQL} select k, true as title, dated as dates, lawful as law, k % 3 = 0 as days, k % 2 = 0 as parties, k % 17 <> 0 as judgeable from facts"""
)
def comparators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 to C4, P6, U5."""
    d, t = contracts(spark, sf_dir), F.col("text")
    answer = F.when(F.col("dated"), F.date_format("d", "M/d/yyyy")).otherwise("")
    return d.select(
        "k",
        compare.same_text(F.concat(F.lower("kind"), F.lit(" - supply   agreement!")), F.concat("kind", F.lit(" SUPPLY AGREEMENT"))).alias("title"),
        compare.same_date(dates.extract_date(t), answer).alias("dates"),
        compare.same_contains(law.rule_law(location.fragments("governing law", t)), F.concat(F.lit("State of "), "place")).alias("law"),
        compare.same_contains(F.expr("case k % 3 when 0 then '2 weeks' when 1 then '1 year' else '3 days' end"), F.expr("case k % 3 when 0 then '14 days' when 1 then '12 months' else '4 days' end")).alias("days"),
        compare.same_parties(F.lit("Norvex Supply; Buyer One"), F.expr("if(k % 2 = 0, 'Buyer one (the Buyer); NORVEX SUPPLY', 'Buyer One; Other')")).alias("parties"),
        compare.judgeable(F.expr("if(k % 17 = 0, '[* * *]', 'x')")).alias("judgeable"),
    )


# ---- rules at hard places ----

_MDY = "strftime({0}, '%-m/%-d/%y')"


@query(
    f"""with {LONG_FACTS_SQL} select k, case k % 4 when 3 then null when 2 then {_MDY.format('other')} else {_MDY.format('d')} end as agreement_date,
    case k % 4 when 2 then {_MDY.format('other')} else {_MDY.format('d')} end as with_unicode,
    cast(case k % 4 when 1 then 2 when 2 then 0 else 1 end as bigint) as anchored from long_facts"""
)
def long_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, F3, L2, L3, L7, T6 on contracts of up to 338,000 characters: several dates in a fragment (the pattern's order decides), one beyond the front matter, no-break spaces without and with Unicode classes."""
    t = F.col("text")
    anchors = F.size(location.around(location.front(t), location.AGREEMENT_DATE, 0, location.AFTER_DATE, location.MOST_DATES)).cast("bigint")
    plain = dates.rule_date(location.fragments("agreement date", t))
    with text.unicode_classes():
        wide = dates.rule_date(location.fragments("agreement date", t))
    return long_contracts(spark, sf_dir).select("k", plain.alias("agreement_date"), wide.alias("with_unicode"), anchors.alias("anchored"))


@query(f"with {LONG_FACTS_SQL} select k, case when k % 3 = 0 then place end as law, cast(case k % 3 when 0 then 2 when 1 then 6 else 1 end as bigint) as fragments, 'SERVICE AGREEMENT' as title from long_facts")
def long_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12, L1, L4, T1, T6, T8 on long contracts: the law at the first anchor, behind six others (the limit), and beyond the window; a title in two pieces behind an exhibit's number."""
    t = F.col("text")
    found = location.fragments("governing law", t)
    return long_contracts(spark, sf_dir).select("k", law.rule_law(found).alias("law"), F.size(found).cast("bigint").alias("fragments"), titles.located_title(t)[0].alias("title"))


@query(f"with {LONG_FACTS_SQL} select k, case when k % 5 < 3 then (k % 90 + 2) || ' days' when k % 5 = 3 then (k % 9 + 2) || ' months' end as notice from long_facts")
def long_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms at the very end of long contracts; weeks don't count."""
    return long_contracts(spark, sf_dir).select("k", terms.rule_notice(location.fragments("notice period to terminate renewal", F.col("text"))).alias("notice"))


_EXPIRES = "case k % 5 when 0 then 'for a period of ' || (k % 40 + 1) || ' months' when 1 then 'for ' || (k % 9 + 1) || ' years' when 2 then 'until the end of the then-current calendar year' when 3 then 'for an uncertain time until March 4, 2021' else 'for zero (0) months, signed May 6, 2022' end"


@query(
    f"""with base as (select cast(o_orderkey as bigint) as k, cast(o_orderdate as date) + cast(o_orderkey % 17 as int) * interval 5 year as d from orders),
    dated as (select k, month(d) as m, day(d) as dd, (year(d) % 100) as yy from base), century as (select *, yy + case when yy < 70 then 2000 else 1900 end as y from dated),
    moved as (select *, case k % 5 when 0 then (m - 1 + k % 40 + 1) % 12 + 1 else m end as m2, case k % 5 when 0 then y + (m - 1 + k % 40 + 1) // 12 when 1 then y + k % 9 + 1 else y + 2 end as y2 from century),
    last as (select *, case when m2 = 2 then case when y2 % 4 = 0 and (y2 % 100 <> 0 or y2 % 400 = 0) then 29 else 28 end when m2 in (4, 6, 9, 11) then 30 else 31 end as most from moved)
    select k, case k % 5 when 2 then '12/31/' || lpad(cast(yy as varchar), 2, '0') when 3 then '3/4/21' when 4 then '5/6/22' else m2 || '/' || case when dd > most then 28 else dd end || '/' || lpad(cast(y2 % 100 as varchar), 2, '0') end as expires from last"""
)
def expiration_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: months over the end of a year, days that a month lacks, years on either side of the century's pivot, the end of the calendar year, a written date, a term of zero."""
    o = _read(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as bigint) as k", "add_months(to_date(o_orderdate), cast(o_orderkey % 17 as int) * 60) as d")
    o = o.selectExpr("k", "concat(month(d), '/', day(d), '/', lpad(cast(year(d) % 100 as string), 2, '0')) as effective", f"{_EXPIRES} as said")
    return o.select("k", terms.rule_expiration(F.array("said"), F.col("effective")).alias("expires"))


# ---- accuracy of rules ----


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, category, answer, value, correct): seven rules over located text, against annotations."""
    return measure.end_to_end(*annotated(spark, sf_dir))


_JUDGED_SQL = f"""{FACTS_SQL}, marked as (
  select k, name, r.category, r.late, k % 7 <> 0 as fine from facts, lateral (select unnest([
    {{'category': 'Document Name', 'given': true, 'late': false}}, {{'category': 'Parties', 'given': true, 'late': true}}, {{'category': 'Agreement Date', 'given': dated, 'late': true}}, {{'category': 'Effective Date', 'given': dated, 'late': true}},
    {{'category': 'Governing Law', 'given': lawful, 'late': false}}, {{'category': 'Expiration Date', 'given': dated, 'late': false}}, {{'category': 'Renewal Term', 'given': true, 'late': false}}, {{'category': 'Notice Period To Terminate Renewal', 'given': true, 'late': false}}]) as r)
  where r.given and k % 17 <> 0),
judged as (select k, name, category, fine and not (late and k % 10 = 9) as correct from marked where category <> 'Expiration Date')"""


@query(f"with {_JUDGED_SQL} select category, count_if(fine) as \"right\", count(*) as n, 100.0 * count_if(fine) / count(*) as pct from marked group by category")
def rule_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rules over the passages that annotators marked."""
    return evaluation.accuracy(measure.located(annotated(spark, sf_dir)[1]), "category")


@query(
    f"""with {_JUDGED_SQL}, whole as (select category, count(*) as n, 100.0 * count_if(correct) / count(*) as pct from judged group by category)
    select category, n, pct, located_pct, pct - located_pct as cost from whole join (select category, 100.0 * count_if(fine) / count(*) as located_pct from marked group by category) using (category)"""
)
def locating_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven rules end to end, over marked passages, and what locating costs: every tenth contract opens beyond the front matter."""
    docs, notes = annotated(spark, sf_dir)
    return measure.cost_of_locating(measure.end_to_end(docs, notes), measure.located(notes))


@query(f"with {_JUDGED_SQL} select category, k, place from (select category, k, row_number() over (partition by category order by k) as place from judged where not correct) where place <= 3")
def rule_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, W4."""
    found = evaluation.sample_failures(_judged(spark, sf_dir), "name")
    return found.select("category", F.substring("name", 7, 12).cast("bigint").alias("k"), "place")


_SHEETS_SQL = f"{_JUDGED_SQL}, sheets as (select name, count_if(correct) as ok, count(*) as n from judged group by name)"


@query(f"with {_SHEETS_SQL} select count(*) as sheets, cast(sum(n) as bigint) as rows, 100.0 * sum(ok) / sum(n) as rows_pct, count_if(ok = n) as perfect, count_if(ok / n >= 0.8) as eighty from sheets")
def sheet_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return evaluation.sheet_summary(evaluation.sheets(_judged(spark, sf_dir)))


@query(f"with {_SHEETS_SQL} select cast(round_even(10.0 * ok / n, 0) as int) as decile, count(*) as sheets from sheets group by 1")
def sheet_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, H8."""
    return evaluation.sheet_deciles(evaluation.sheets(_judged(spark, sf_dir)))


@query(
    f"""with {FACTS_SQL}, said as (select 'date' as category, dated and k % 4 in (0, 3) as naive, dated as product from facts union all
    select 'law', lawful and place = 'Delaware', lawful from facts union all select 'title', k % 11 <> 0, true from facts)
    select category, 100.0 * count_if(naive) / count(*) as naive_pct, 100.0 * count_if(product) / count(*) as product_pct, 100.0 * count_if(product) / count(*) - 100.0 * count_if(naive) / count(*) as gain from said group by category"""
)
def naive_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, F16 to F18."""
    t, title = F.col("text"), F.concat("kind", F.lit(" SUPPLY AGREEMENT"))
    day, place = F.when(F.col("dated"), F.date_format("d", "M/d/yyyy")), F.when(F.col("lawful"), F.col("place"))
    rows = [
        ("date", compare.same_date(dates.naive_date(t), day), compare.same_date(dates.rule_date(location.agreement_date(t)), day)),
        ("law", compare.same_contains(law.naive_law(t), place), compare.same_contains(law.rule_law(location.fragments("governing law", t)), place)),
        ("title", compare.same_text(titles.naive_title(t), title), compare.same_text(titles.rule_title(location.fragments("document name", t)), title)),
    ]
    both = contracts(spark, sf_dir).select(F.explode(F.array(*(F.struct(F.lit(c).alias("category"), a.alias("naive"), b.alias("product")) for c, a, b in rows))).alias("r")).select("r.*")
    pct = lambda c: 100.0 * F.count_if(c) / F.count(F.lit(1))
    return both.groupBy("category").agg(pct("naive").alias("naive_pct"), pct("product").alias("product_pct"), (pct("product") - pct("naive")).alias("gain"))


# ---- groups ----


def _tally(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """Rows by clause (junk, toxic) and group, right if the naive answer "not present" is right."""
    joined = _labels(spark, sf_dir).join(_docs(spark, sf_dir).select("name", by), "name")
    return evaluation.accuracy(joined.select(F.col("category").alias("clause"), F.col(by).alias("grp"), (~F.col("label")).alias("correct")), "clause", "grp")


def _tally_sql(by: str) -> str:
    return f"{_DOCS_SQL}, tally as (select category as clause, {by} as grp, count_if(not label) as ok, count(*) as n from labelled join base using (name) group by 1, 2)"


@query(f"with {_tally_sql('lang')} select clause, grp, ok as \"right\", n, 100.0 * ok / n as pct from tally")
def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    return _tally(spark, sf_dir, "lang")


_WILSON = "greatest(0.0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)) as low, least(1.0, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)) as high"


@query(f"with {_tally_sql('lang')}, rated as (select *, cast(ok as double) / n as p, cast(1.96 as double) as z from tally) select clause, grp, round({_WILSON.split(' as low')[0]}, 9) as low, round({_WILSON.split(' as low, ')[1].split(' as high')[0]}, 9) as high from rated")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    low, high = evaluation.wilson(F.col("right"), F.col("n"))
    return _tally(spark, sf_dir, "lang").select("clause", "grp", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(
    f"""with {_tally_sql('source')}, groups as (select grp from tally group by grp having sum(n) >= 5 * (select count(distinct clause) from tally)),
    rated as (select clause, cast(ok as double) / n as p, n, cast(1.96 as double) as z from tally where grp in (select grp from groups) and n >= 5), ends as (select clause, p, {_WILSON} from rated)
    select clause, round(100 * (max(p) - min(p)), 9) as spread, max(low) > min(high) as separate, 100 * (max(p) - min(p)) >= 30 and max(low) > min(high) as gap from ends group by clause"""
)
def gap_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, A18, A20."""
    return evaluation.gap_verdict(_tally(spark, sf_dir, "source")).withColumn("spread", F.round("spread", 9))


@query(
    """with lengths as (select doc_id, length(text) as chars from documents), ordered as (select chars, row_number() over (order by chars) - 1 as r, count(*) over () as n from lengths),
    cuts as (select max(chars) filter (r = n * 1 // 4) as a, max(chars) filter (r = n * 2 // 4) as b, max(chars) filter (r = n * 3 // 4) as c from ordered)
    select doc_id, case when chars <= a then 'Q1' when chars <= b then 'Q2' when chars <= c then 'Q3' else 'Q4' end as quartile from lengths, cuts"""
)
def length_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    d = _docs(spark, sf_dir).select("doc_id", F.length("text").alias("chars"))
    return evaluation.length_quartiles(d, "chars").select("doc_id", "quartile")


@query(f"with {FACTS_SQL} select upper(kind) || ' AGREEMENT' as agreement, count(*) as n from facts group by 1")
def agreement_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19, T10."""
    return contracts(spark, sf_dir).groupBy(evaluation.agreement_type(F.col("name")).alias("agreement")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {_DOCS_SQL}, counts as (select category, count_if(label) as yes, count_if(not label) as no from labelled group by category)
    select category, yes, no, yes + no as total, 100.0 * greatest(yes, no) / (yes + no) as floor_pct, case when yes >= no then 'Yes' else 'No' end as majority,
    case when 100.0 * greatest(yes, no) / (yes + no) < 65 then 'accuracy' else 'minority_recall' end as valid_metric, least(yes, no) as confirmations from counts"""
)
def majority_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category with other answers and one with blanks only are no presence categories."""
    answers = _labels(spark, sf_dir).select("category", F.when(F.col("label"), " Yes ").otherwise("No").alias("answer"))
    odd = answers.limit(1).select(F.lit("free text").alias("category"), F.lit("maybe").alias("answer"))
    blank = answers.limit(1).select(F.lit("blank").alias("category"), F.lit(" ").alias("answer"))
    return evaluation.majority_floor(answers.unionByName(odd).unionByName(blank))


@query(
    f"""with {_DOCS_SQL}, counts as (select category, count_if(label) as yes, count_if(not label) as no from labelled group by category), floors as (select 100.0 * greatest(yes, no) / (yes + no) as f, least(yes, no) as c from counts)
    select count(*) as categories, avg(f) as mean_floor, count_if(f >= 75) as skewed, count_if(f < 65) as balanced, cast(sum(c) as bigint) as confirmations from floors"""
)
def floor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return evaluation.floor_summary(majority_floor(spark, sf_dir))


@query(
    f"""with {_DOCS_SQL}, counts as (select category, count_if(label) as si, count_if(not label) as no from labelled group by category)
    select category, si, no, si + no as total, round(100.0 * greatest(si, no) / (si + no), 1) as trivial_floor_pct, case when si >= no then 'Yes' else 'No' end as majority_class,
    case when 100.0 * greatest(si, no) / (si + no) < 65 then 'accuracy' else 'recall_clase_minoritaria' end as valid_metric, least(si, no) as human_confirmations from counts"""
)
def floor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor as its file shows it."""
    return evaluation.floor_report(majority_floor(spark, sf_dir))


# ---- learning ----

_SPLIT_SQL = f"""{_DOCS_SQL}, ordered as (select name, row_number() over (order by name) - 1 as r, count(*) over () as n from (select distinct name from labelled)),
split as (select name, case when r < floor(n * 0.6::double) then 'train' when r < floor(n * 0.8::double) then 'val' else 'test' end as part from ordered)"""
_FREQ_SQL = f"""{_SPLIT_SQL}, words as (select name, unnest({_WORDS_SQL.format('text')}) as term from base where name in (select name from split where part = 'train')),
frequency as (select category, term, cast(count_if(label) as bigint) as w, cast(count_if(not label) as bigint) as o from words join labelled using (name) group by 1, 2)"""
_CUES_SQL = f"""{_FREQ_SQL}, totals as (select category, count_if(label) as nw, count_if(not label) as no from labelled where name in (select name from split where part = 'train') group by category having count_if(label) >= 5),
scored as (select category, term, round(ln(((w + 0.5) / (nw + 1)) / ((o + 0.5) / (no + 1))), 12) as s from frequency join totals using (category)),
cues as (select category, term, s, row_number() over (partition by category order by s desc, term) as place from scored where s > 0 qualify place <= 40)"""
_SCORED_SQL = f"""{_CUES_SQL}, lists as (select category, list(term) filter (term is not null) as terms from (select distinct category from labelled) left join cues using (category) group by category),
cut as (select name, stop, text, unnest(range(0, greatest(1, length(text)), 800)) as start from base where name in (select name from split where part <> 'train')),
sets as (select name, start, {_WORDS_SQL.format('substr(text, cast(start + 1 as int), 1600)')} as words from cut),
best as (select name, category, case when len(terms) > 0 then cast(len(list_intersect(words, terms)) as double) / len(terms) else 0 end as score, start from sets, lists qualify row_number() over (partition by name, category order by coalesce(len(list_intersect(words, terms)), 0) desc, start) = 1),
scored_docs as (select best.name, best.category, score, case when score > 0 then start end as start, label, part from best join labelled using (name, category) join split using (name))"""
_SWEEP_SQL = f"""{_SCORED_SQL}, swept as (select category, step, count_if(label and score >= step / 40.0::double) as tp, count_if(not label and score < step / 40.0::double) as tn, count_if(label) as n_pos, count_if(not label) as n_neg
  from scored_docs, (select unnest(range(1, 41)) as step) where part = 'val' group by 1, 2),
thresholds as (select category, case when n_pos >= 5 and n_neg >= 5 then case when (tp / n_pos + tn / n_neg) / 2 > 0 then step / 40.0::double else 0.5 end end as threshold from swept qualify row_number() over (partition by category order by (tp / n_pos + tn / n_neg) / 2 desc, step) = 1)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.split_by_name(_labels(spark, sf_dir).select("name").distinct())


def _trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels and documents with their part, and the learned cue lists."""
    parts = _parts(spark, sf_dir)
    labels, docs = _labels(spark, sf_dir).join(parts, "name"), _docs(spark, sf_dir).join(parts, "name")
    train = labels.where("part = 'train'")
    frequency = learning.document_frequency(docs.where("part = 'train'"), train)
    return labels, docs, learning.cue_table(learning.cue_terms(frequency, train), labels)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, category, score, start, label, part, text) of the documents that learning didn't see."""
    labels, docs, cues = _trained(spark, sf_dir)
    return windows.score(docs.where("part <> 'train'"), cues).join(labels.drop("part"), ["name", "category"])


def _with_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    gold = F.substring("text", F.col("doc_id") % 2 * 800 + 1, F.lit(70))  # a passage that only some best windows hold
    scored = scored.select("name", "category", "score", "start", "label", "part", learning.located(F.col("text"), F.col("start"), gold).alias("located"))
    found = learning.thresholds(learning.sweep(scored.where("part = 'val'")))
    return scored.join(F.broadcast(found), "category")


@query(f"with {_SPLIT_SQL} select name, part from split")
def split_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2, P8."""
    return _parts(spark, sf_dir)


@query(f"with {_FREQ_SQL} select category, term, w as with_clause, o as without_clause from frequency")
def token_doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, U1."""
    parts = _parts(spark, sf_dir).where("part = 'train'")
    return learning.document_frequency(_docs(spark, sf_dir).join(parts, "name", "left_semi"), _labels(spark, sf_dir))


@query(f"with {_CUES_SQL} select category, term, place from cues")
def cue_terms_top40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3, W1."""
    parts = _parts(spark, sf_dir).where("part = 'train'")
    labels = _labels(spark, sf_dir).join(parts, "name", "left_semi")
    return learning.cue_terms(learning.document_frequency(_docs(spark, sf_dir).join(parts, "name", "left_semi"), labels), labels).select("category", "term", "place")


@query(f"with {_SWEEP_SQL} select category, step, tp as true_pos, tn as true_neg, round((tp / n_pos + tn / n_neg) / 2, 9) as balanced from swept")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return learning.sweep(_scored(spark, sf_dir).where("part = 'val'")).select("category", "step", "true_pos", "true_neg", F.round("balanced", 9).alias("balanced"))


@query(f"with {_SWEEP_SQL} select category, threshold from thresholds")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, A7."""
    return learning.thresholds(learning.sweep(_scored(spark, sf_dir).where("part = 'val'")))


_LOCATED = "case when start is not null then trim(regexp_replace(substr(text, cast(doc_id % 2 * 800 + 1 as int), 70), '\\s+', ' ', 'g')) <> '' and contains(trim(regexp_replace(substr(text, cast(start + 1 as int), 1600), '\\s+', ' ', 'g')), left(trim(regexp_replace(substr(text, cast(doc_id % 2 * 800 + 1 as int), 70), '\\s+', ' ', 'g')), 60)) end"
_CONFUSION = "count_if(label and score >= threshold) as tp, count_if(not label and score < threshold) as tn, count_if(label) as p, count_if(not label) as q"


@query(
    f"""with {_SWEEP_SQL}, counts as (select category, {_CONFUSION}, avg(case when label and score >= threshold then cast({_LOCATED} as int) end) as hit from scored_docs join thresholds using (category) join base using (name) where part = 'test' and threshold is not null group by category having p > 0 and q > 0)
    select category, p + q as n, p as positives, 100.0 * greatest(p, q) / (p + q) as floor, 100.0 * (tp + tn) / (p + q) as accuracy, round(100.0 * (tp / p + tn / q) / 2, 9) as balanced, 100.0 * tp / p as recall, 100.0 * tn / q as specificity, 100.0 * hit as located_pct from counts"""
)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the share of true positives whose window holds the gold passage."""
    return learning.metrics(_with_thresholds(spark, sf_dir).where("part = 'test'")).withColumn("balanced", F.round("balanced", 9))


@query(
    f"""with {_SWEEP_SQL}, counts as (select category, {_CONFUSION} from scored_docs join thresholds using (category) where part = 'test' and threshold is not null group by category having p > 0 and q > 0)
    select round(avg(100.0 * (tp / p + tn / q) / 2), 9) as mean_balanced, coalesce(count_if(100.0 * (tp / p + tn / q) / 2 > 55), 0) as above_55, count(*) as measured,
    coalesce((select string_agg(category, ', ' order by category) from (select distinct category from labelled) where category not in (select category from counts)), '') as not_measured from counts"""
)
def detector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, T3."""
    judged = _with_thresholds(spark, sf_dir).where("part = 'test'")
    return learning.summary(learning.metrics(judged), _labels(spark, sf_dir)).withColumn("mean_balanced", F.round("mean_balanced", 9))


@query(
    """with pairs as (select doc_id, d.text as doc, b.text as gold, strpos(d.text, b.text) as pos from documents d join benchmark b on contains(d.text, b.text)),
    placed as (select doc_id, gold, doc, (pos - 1) // 800 * 800 as start from pairs)
    select doc_id, start, contains(trim(regexp_replace(substr(doc, start + 1, 1600), '\\s+', ' ', 'g')), left(trim(regexp_replace(gold, '\\s+', ' ', 'g')), 60)) as located from placed"""
)
def location_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the window before a benchmark passage's place holds its beginning.

    The benchmark items are the gold passages; a document meets an item through six words of it, by an equality join, and is then verified.
    """
    gold = _read(spark, sf_dir, "benchmark").select(F.col("text").alias("gold"))
    words = _read(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", " ").alias("w"))
    grams = F.expr(f"transform(w, (x, i) -> xxhash64(x, {', '.join(f'get(w, i + {j})' for j in range(1, 6))}))")
    keyed = words.select("doc_id", "text", F.explode(grams).alias("gram"))
    # The second to seventh word of a passage are whole words wherever it stands.
    known = gold.select("gold", F.expr(f"xxhash64({', '.join(f'get(split(gold, chr(32)), {j})' for j in range(1, 7))})").alias("gram"))
    pairs = keyed.join(known, "gram").where(F.contains("text", F.col("gold")))
    placed = pairs.withColumn("start", F.expr("(locate(gold, text) - 1) div 800 * 800"))
    return placed.select("doc_id", "gold", "start", learning.located(F.col("text"), F.col("start").cast("int"), F.col("gold")).alias("located")).distinct().drop("gold")


# ---- calibration ----

_MARGIN_SQL = f"""{_SWEEP_SQL}, observed as (select name, category, part, (score >= threshold) = label as correct, case when abs(score - threshold) >= 0.0::double and abs(score - threshold) < 0.02::double then 0 when abs(score - threshold) < 0.05::double then 1 when abs(score - threshold) < 0.1::double then 2 else 3 end as bin
  from scored_docs join thresholds using (category) where threshold is not null),
bins as (select category, bin, count(*) as n, avg(correct::int) as accuracy from observed where part = 'val' group by 1, 2),
fallback as (select category, avg(correct::int) as accuracy from observed where part = 'val' group by 1)"""


def _observed(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    return calibration.observations(_with_thresholds(spark, sf_dir).where(F.col("part") == part))


@query(f"with {_MARGIN_SQL} select category, bin, round(b.accuracy, 9) as accuracy, round(f.accuracy, 9) as fallback from bins b join fallback f using (category) where n >= 8")
def margin_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21, A23, J12."""
    fitted = calibration.fit(_observed(spark, sf_dir, "val"))
    return fitted.select("category", F.explode("bins").alias("bin", "accuracy"), "fallback").select("category", "bin", F.round("accuracy", 9).alias("accuracy"), F.round("fallback", 9).alias("fallback"))


_STATED_SQL = "stated as (select o.category, o.bin, count(*) as n, avg(o.correct::int) as actual, max(coalesce(case when b.n >= 8 then b.accuracy end, f.accuracy)) as said, max(f.accuracy) as flat from observed o join fallback f using (category) left join bins b on b.category = o.category and b.bin = o.bin where o.part = 'test' group by 1, 2)"


@query(f"with {_MARGIN_SQL}, {_STATED_SQL} select coalesce(round(sum(n * abs(said - actual)) / sum(n), 9), 0) as calibrated, coalesce(round(sum(n * abs(flat - actual)) / sum(n), 9), 0) as flat from stated")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22, J5."""
    rows = _with_thresholds(spark, sf_dir)
    fitted = calibration.fit(calibration.observations(rows.where("part = 'val'")))
    test = calibration.observations(rows.where("part = 'test'")).groupBy("category", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("actual"))
    both = test.join(F.broadcast(fitted), "category").select("n", "actual", F.coalesce(F.col("bins")[F.col("bin")], F.col("fallback")).alias("said"), F.col("fallback").alias("flat"))
    one = calibration.expected_error(both.withColumnRenamed("said", "stated")).select(F.round("ece", 9).alias("calibrated"))
    return one.crossJoin(calibration.expected_error(both.withColumnRenamed("flat", "stated")).select(F.round("ece", 9).alias("flat")))


@query(f"with {_MARGIN_SQL} select o.name, o.category, round(100 * coalesce(case when b.n >= 8 then b.accuracy end, f.accuracy), 9) as confidence from observed o join fallback f using (category) left join bins b on b.category = o.category and b.bin = o.bin where o.part = 'test'")
def row_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4."""
    rows = _with_thresholds(spark, sf_dir).where("threshold is not null")
    fitted = calibration.fit(calibration.observations(rows.where("part = 'val'")))
    test = rows.where("part = 'test'").join(F.broadcast(fitted), "category")
    return test.select("name", "category", F.round(calibration.row_confidence(F.col("score"), F.col("threshold"), F.col("bins"), F.col("fallback")), 9).alias("confidence"))


# ---- states, scope, categories ----


@query(
    """with s as (select doc_id, (doc_id % 41) / 40.0::double as score, case when doc_id % 7 = 0 then null else 0.5::double end as threshold, case when doc_id % 11 = 0 then null when doc_id % 2 = 0 then 70.0::double else 40.0::double end as recall, case when doc_id % 3 = 0 then 'human' else 'retrieval' end as bucket from documents),
    t as (select *, case when threshold is null or recall is null then 'review' when score >= threshold then 'found' when recall >= 60 then 'absent' else 'absent_review' end as state from s)
    select doc_id, state, case when bucket = 'human' and state = 'found' then 'review' when bucket = 'human' and state = 'absent' then 'absent_review' else state end as demoted from t"""
)
def presence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5, R7."""
    d = _read(spark, sf_dir, "documents").selectExpr("doc_id", "(doc_id % 41) / 40.0D as score", "if(doc_id % 7 = 0, null, 0.5D) as threshold", "case when doc_id % 11 = 0 then null when doc_id % 2 = 0 then 70.0D else 40.0D end as recall", "if(doc_id % 3 = 0, 'human', 'retrieval') as bucket")
    d = d.withColumn("state", sheet.presence_state(F.col("score"), F.col("threshold"), F.col("recall")))
    return d.select("doc_id", "state", sheet.demote(F.col("state"), F.col("bucket")).alias("demoted"))


_NAMES = ["Document Name", "Parties", "Agreement Date", "Governing Law", "Notice Period to Terminate Renewal", "Renewal Term", "Cap on Liability", "Insurance", "License Grant"]


@query(
    """select * from (values ('Document Name', 'rule', true, 'Document Name.', null, 'a'), ('Parties', 'model', true, 'Parties.', 3.5, 'b'), ('Agreement Date', 'rule', true, 'Agreement Date.', null, null),
    ('Governing Law', 'rule', true, 'Governing Law.', null, null), ('Notice Period to Terminate Renewal', 'hybrid', true, 'Notice Period to Terminate Renewal.', null, null), ('Renewal Term', 'human', false, 'Renewal Term.', null, null),
    ('Cap on Liability', 'human', false, 'Cap on Liability.', null, null), ('Insurance', 'retrieval', true, 'Insurance.', null, null), ('License Grant', 'retrieval', true, 'License Grant.', null, null)) t(category, bucket, closes_alone, description, measured, note)"""
)
def bucket_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets, cells without their labels, attributes that some categories have."""
    cells = spark.createDataFrame([(f"Category: {n}", f"Description: {n}.", "Answer Format: ", "Group: 1") for n in _NAMES], "category string, description string, format string, `group` string")
    extra = spark.createDataFrame([("Document Name", None, "a"), ("Parties", 3.5, "b"), ("Not There", 1.0, "c")], "category string, measured double, note string")
    return scope.categories(cells, extra).select("category", "bucket", "closes_alone", "description", "measured", "note")


@query("select * from (values ('hybrid', 1, 1), ('human', 2, 0), ('model', 1, 1), ('retrieval', 2, 2), ('rule', 3, 3)) t(bucket, n, alone)")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    return scope.bucket_counts(bucket_assign(spark, sf_dir))


@query(
    """select * from (values ('wrong number', '9'), ('unknown name', 'Anti-Assignment'), ('unknown name', 'Change of Control'), ('unknown name', 'Effective Date'), ('unknown name', 'Exclusivity'), ('unknown name', 'Expiration Date'),
    ('unknown name', 'IP Ownership Assignment'), ('unknown name', 'Joint IP Ownership'), ('unknown name', 'Liquidated Damages'), ('unknown name', 'Minimum Commitment'), ('unknown name', 'Most Favored Nation'), ('unknown name', 'Non-Compete'),
    ('unknown name', 'Parties (dropped from rule bucket)'), ('unknown name', 'Source Code Escrow'), ('unknown name', 'Uncapped Liability')) t(problem, category)"""
)
def config_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, U4."""
    return scope.validate(bucket_assign(spark, sf_dir))


_RULES = [("Governing Law", 91.0), ("Agreement Date", 73.6), ("Document Name", 71.7), ("Effective Date", 64.9), ("Renewal Term", 48.8)]
_PRESENCE = [("Cap On Liability", 84.3, 88.0), ("Insurance", 75.6, 71.0), ("Warranty Duration", 77.0, 75.0), ("Audit Rights", 74.6, 69.9), ("Unknown Clause", 70.0, 70.0)]
_BASE = [("Governing Law", 38.0, 90.0), ("Agreement Date", 80.0, 74.0), ("Cap on Liability", 42.0, 86.0), ("Warranty Duration", 83.0, 76.0)]


def _values(rows: list[tuple]) -> str:
    return "(values " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::double" for x in r) + ")" for r in rows) + ")"


@query(
    f"""with rules(category, measure) as (select * from {_values(_RULES)}), presence(category, balanced, recall) as (select * from {_values(_PRESENCE)}), base(category, naive, product) as (select * from {_values(_BASE)}),
    met as (select category, 'rule' as engine, measure, null::double as recall, measure >= 65 as good from rules union all select category, 'presence', balanced, recall, balanced >= 70 and recall >= 70 from presence)
    select met.category, engine, measure, recall, naive, good and coalesce(product > naive, true) as in_scope from met left join base on met.category = base.category"""
)
def scope_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, P14, J6 to J8, U2."""
    make = spark.createDataFrame
    return scope.decide(make(_RULES, "category string, measure double"), make(_PRESENCE, "category string, balanced double, recall double"), make(_BASE, "category string, naive double, product double"))


# ---- joins of annotations ----


@query(f"with {FACTS_SQL}, rows as (select name || case when k % 2 = 0 then '.pdf' else '.PDF' end as file, k from facts) select count(*) as matched, (select count(*) from facts where k % 6 = 0) as unmatched from rows where k % 6 <> 0")
def annotation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations by file name against the corpus, a sixth of which is missing."""
    corpus = contracts(spark, sf_dir).select("k", "name")
    files = corpus.select(F.concat("name", F.when(F.col("k") % 2 == 0, ".pdf").otherwise(".PDF")).alias("file")).select(text.stem(F.col("file")).alias("name"))
    held = corpus.where(F.col("k") % 6 != 0).select("name", F.lit(True).alias("held"))
    return files.join(held, "name", "left").agg(F.count_if("held").alias("matched"), F.count_if(F.col("held").isNull()).alias("unmatched"))


# ---- the sheet ----

SHEET_RULES = [("Document Name", "rule", 71.7), ("Governing Law", "rule", 91.0), ("Agreement Date", "rule", 73.6), ("Effective Date", "rule", 68.0), ("Notice Period to Terminate Renewal", "hybrid", 42.9), ("Renewal Term", "human", 52.0)]
_MODEL = [
    ("Renewal Notice", "retrieval", ["notice", "renewal", "written", "automatically"], 0.5, 90.0, 80.0, 60.0, {0: 0.6, 3: 0.9}, 0.8),
    ("Liability Cap", "human", ["notice", "renewal"], 0.5, 90.0, 80.0, 60.0, {}, 0.7),
    ("Law Named", "retrieval", ["governed", "laws"], 0.75, 70.0, 75.0, None, {}, 0.7),
    ("Never There", "retrieval", ["insurance", "policy"], 0.5, 50.0, 71.0, 10.0, {}, 0.7),
    ("Not Learned", "retrieval", [], None, None, None, None, {}, None),
]
MODEL_SCHEMA = "category string, bucket string, cues array<string>, threshold double, recall double, balanced double, located_pct double, bins map<int, double>, fallback double"


def model(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_MODEL, MODEL_SCHEMA)


_SHEET_SQL = f"""with {FACTS_SQL} select name, category, bucket, state, value, confidence, engine from (
  select name, 'Document Name' as category, 'rule' as bucket, 'found' as state, kind || ' SUPPLY AGREEMENT' as value, 71.7::double as confidence, 'rule' as engine from facts
  union all select name, 'Governing Law', 'rule', case when lawful then 'found' else 'absent' end, case when lawful then place end, 91.0, 'rule' from facts
  union all select name, 'Agreement Date', 'rule', case when dated then 'found' else 'absent' end, case when dated then mdy end, 73.6, 'rule' from facts
  union all select name, 'Effective Date', 'rule', case when dated then 'found' else 'absent' end, case when dated then mdy end, 68.0, 'rule' from facts
  union all select name, 'Notice Period to Terminate Renewal', 'hybrid', 'model_pending', null, 42.9, 'rule' from facts
  union all select name, 'Renewal Term', 'human', 'review', '1 year', 52.0, 'rule' from facts
  union all select name, 'Renewal Notice', 'retrieval', 'found', 'present', 90.0, 'presence' from facts
  union all select name, 'Liability Cap', 'human', 'review', null, 70.0, 'presence' from facts
  union all select name, 'Law Named', 'retrieval', case when lawful then 'found' else 'absent' end, case when lawful then 'present' end, 70.0, 'presence' from facts
  union all select name, 'Never There', 'retrieval', 'absent_review', null, 70.0, 'presence' from facts
  union all select name, 'Not Learned', 'retrieval', 'review', null, null, 'presence' from facts)"""


@query(_SHEET_SQL)
def clause_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship."""
    rows = sheet.sheet(contracts(spark, sf_dir).select("name", "text"), SHEET_RULES, model(spark))
    return rows.select("name", "category", "bucket", "state", "value", F.round("confidence", 9).alias("confidence"), "engine")


@query(f"select name, count_if(state in ('found', 'absent')) as closed, count_if(state in ('review', 'absent_review')) as to_review, count_if(state = 'model_pending') as pending, count(*) as rows from ({_SHEET_SQL}) group by name")
def sheet_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26."""
    return sheet.footer(clause_sheet(spark, sf_dir))


@query(
    f"""with {LONG_FACTS_SQL}, named as (select *, 'Long_' || lpad(cast(k as varchar), 9, '0') || '-Master Agreement' as name, case k % 4 when 3 then null when 2 then strftime(other, '%-m/%-d/%y') else strftime(d, '%-m/%-d/%y') end as mdy from long_facts)
    select name, r.category, r.state, r.value from named, lateral (select unnest([
      {{'category': 'Document Name', 'state': 'found', 'value': 'SERVICE AGREEMENT'}}, {{'category': 'Governing Law', 'state': case when k % 3 = 0 then 'found' else 'absent' end, 'value': case when k % 3 = 0 then place end}},
      {{'category': 'Agreement Date', 'state': case when mdy is null then 'absent' else 'found' end, 'value': mdy}}, {{'category': 'Effective Date', 'state': case when mdy is null then 'absent' else 'found' end, 'value': mdy}},
      {{'category': 'Notice Period to Terminate Renewal', 'state': 'model_pending', 'value': null}}, {{'category': 'Renewal Term', 'state': 'review', 'value': null}}, {{'category': 'Renewal Notice', 'state': 'absent', 'value': null}},
      {{'category': 'Liability Cap', 'state': 'review', 'value': null}}, {{'category': 'Law Named', 'state': case when k % 3 = 2 then 'absent' else 'found' end, 'value': case when k % 3 <> 2 then 'present' end}},
      {{'category': 'Never There', 'state': 'absent_review', 'value': null}}, {{'category': 'Not Learned', 'state': 'review', 'value': null}}]) as r)"""
)
def long_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 to R8 on contracts of 50,000 to 338,000 characters."""
    rows = sheet.sheet(long_contracts(spark, sf_dir).select("name", "text"), SHEET_RULES, model(spark))
    return rows.select("name", "category", "state", "value")


@query(
    f"""with {FACTS_SQL} select name, category, confidence_kind, clause_accuracy, cast(null as int) as start, cast(chars as int) as chars, edge from (
      select name, 'Document Name' as category, 'clause' as confidence_kind, 71.7::double as clause_accuracy, length(kind || ' SUPPLY AGREEMENT') as chars, left(kind, 3) as edge from facts
      union all select name, 'Governing Law', 'clause', 91.0, case when lawful then 300 end, null from facts)"""
)
def sheet_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rule row carries beside its value: the first fragment, cut to 300 characters, its category's accuracy, and no place."""
    rows = sheet.sheet(contracts(spark, sf_dir).select("name", "text"), [("Document Name", "rule", 71.7), ("Governing Law", "rule", 91.0)], model(spark).limit(0))
    edge = F.when(F.col("category") == "Document Name", F.left("text", F.lit(3)))
    return rows.select("name", "category", "confidence_kind", "clause_accuracy", "start", F.length("text").alias("chars"), edge.alias("edge"))


@query(f"select name, category, state from ({_SHEET_SQL}) where category in ('Document Name', 'Governing Law')")
def scoped_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet's rows of the categories that the scope decision admits."""
    return sheet.scoped(contracts(spark, sf_dir).select("name", "text"), SHEET_RULES, model(spark), scope_decision(spark, sf_dir)).select("name", "category", "state")


@query(
    """select cast(o_orderkey as bigint) as k, case o_orderkey % 6 when 0 then 'perpetual' when 1 then '2 years' when 2 then '18 months' when 3 then null when 4 then '45 months' else '1 year' end as renewal,
    cast(case o_orderkey % 4 when 0 then o_orderkey % 50 + 1 when 1 then 7 * (o_orderkey % 50 + 1) when 2 then 30 * (o_orderkey % 50 + 1) else 365 * (o_orderkey % 50 + 1) end as bigint) as days from orders"""
)
def renewal_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perpetual terms, words and digits, units that don't count, the nearest of several, each unit's days."""
    said = """case k % 6 when 0 then 'The licence is perpetual and renews every 3 years' when 1 then 'It renews for two (2) years' when 2 then 'It is extended by eighteen months'
      when 3 then 'It renews for 12 days or three weeks' when 4 then concat('After 3 years, which have nothing to do with it. ', repeat('Many words stand between them. ', 8), 'successive terms of forty-five (45) months') else 'a term of one (1) year' end"""
    unit = "case k % 4 when 0 then 'day' when 1 then 'week' when 2 then 'month' else 'year' end"
    o = _read(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as bigint) as k").selectExpr("k", f"{said} as said", f"concat('about ', k % 50 + 1, ' ', upper({unit}), 's, later 9 days') as span")
    return o.select("k", terms.rule_renewal(F.array("said")).alias("renewal"), terms.to_days(F.col("span")).alias("days"))


@query(
    """select c_custkey, case c_custkey % 5 when 0 then 'India' when 1 then 'Washington' when 2 then 'West Virginia' when 3 then null else 'Ohio' end as naive,
    case c_custkey % 5 when 0 then 'Indiana' when 1 then 'Nova Scotia' when 2 then 'West Virginia' when 3 then null else 'Pennsylvania' end as ruled from customer"""
)
def law_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name without regard to word ends (Indiana is India), against the name in the phrase, else the longest name anywhere."""
    said = """case c_custkey % 5 when 0 then 'under the laws of the State of Indiana, unlike Ohio' when 1 then 'Washington first, then NOVA SCOTIA' when 2 then 'in west virginia or Virginia'
      when 3 then 'under no law of Atlantis' else 'Ohio courts apply Pennsylvania rules; nothing of Texas' end"""
    c = _read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{said} as said")
    return c.select("c_custkey", law.naive_law(F.col("said")).alias("naive"), law.rule_law(F.array("said")).alias("ruled"))
