"""Contracts written from the relational tables, so that every answer is known.

One contract an order: title, date, parties, terms and law follow from the order's key, its date and its customer. Dates
are spelled in four ways in turn; some contracts have no date, some name no law, some carry a redacted answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PLACES = ("New York", "Delaware", "California", "Texas", "England", "Ontario", "India", "Singapore")

_SPELLED = """case o_orderkey % 4
  when 0 then date_format(d, 'MMMM d, yyyy')
  when 1 then concat(day(d), 'th day of ', date_format(d, 'MMMM, yyyy'))
  when 2 then date_format(d, 'd MMMM yyyy')
  else date_format(d, 'M/d/yyyy') end"""


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, name, kind, d, place, years, notice_days, dated, lawful, text)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    joined = orders.join(read("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    facts = joined.selectExpr(
        "o_orderkey as k",
        "concat('Order_', lpad(cast(o_orderkey as string), 12, '0'), '_', c_mktsegment, ' Agreement', o_orderkey % 3 + 1) as name",
        "c_mktsegment as kind",
        "d",
        f"element_at(array({', '.join(repr(p) for p in PLACES)}), cast(o_orderkey % 8 + 1 as int)) as place",
        "o_orderkey % 5 + 2 as years",
        "o_orderkey % 90 + 1 as notice_days",
        "o_orderkey % 13 <> 0 as dated",
        "o_orderkey % 5 <> 0 as lawful",
        f"{_SPELLED} as spelled",
        "o_custkey as c",
    )
    # The orders' file is small and what is written from it isn't: spread it before.
    facts = facts.repartition(2 * spark.sparkContext.defaultParallelism, "k")
    text = F.expr(
        r"""concat(
        if(k % 11 = 0, 'EXHIBIT 10.4\n\n', ''), kind, ' SUPPLY AGREEMENT\n\n',
        'This agreement is ', if(dated, concat('dated as of ', spelled), 'undated'), ' by and between Buyer ', c, ' Trading Co ("Buyer") and Norvex Supply LLC, a Delaware corporation ("Seller").\n\n',
        'It shall continue for ', years, ' years and shall automatically renew for successive one (1) year terms unless a party gives written notice of non-renewal at least ', notice_days, ' days prior to the end of the term.\n',
        if(lawful, concat('This agreement shall be governed by the laws of the State of ', place, '.\n'), 'The parties shall settle all disputes among themselves.\n'))"""
    )
    return facts.withColumn("text", text)


#: The same facts for DuckDB: each query's answers follow from these, without reading a text.
FACTS_SQL = """facts as (
  select o_orderkey as k, o_custkey as c, c_mktsegment as kind, cast(o_orderdate as date) as d,
    'Order_' || lpad(cast(o_orderkey as varchar), 12, '0') || '_' || c_mktsegment || ' Agreement' || (o_orderkey % 3 + 1) as name,
    (['New York', 'Delaware', 'California', 'Texas', 'England', 'Ontario', 'India', 'Singapore'])[cast(o_orderkey % 8 + 1 as int)] as place,
    o_orderkey % 5 + 2 as years, o_orderkey % 90 + 1 as notice_days, o_orderkey % 13 <> 0 as dated, o_orderkey % 5 <> 0 as lawful,
    strftime(cast(o_orderdate as date), '%-m/%-d/%y') as mdy
  from orders join customer on o_custkey = c_custkey)"""


#: Filler before the opening of every tenth contract: its date and parties then stand beyond the front matter.
LATE = "k % 10 = 9"


def annotated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The contracts, every tenth with its opening far behind, as (k, name, kind, text), and their annotations (name, category, spans, answer).

    Every seventh answer is wrong and every seventeenth redacted; what a contract doesn't say has neither span nor answer.
    """
    base = contracts(spark, sf_dir)
    docs = base.withColumn("text", F.expr(f"if({LATE}, concat(kind, ' SUPPLY AGREEMENT\\n\\n', repeat('Words about deliveries, invoices and returns follow here. ', 170), text), text)"))
    written = "date_format({0}, 'M/d/yyyy')"
    ends = "if(month(d) = 2 and day(d) = 29 and (year(d) + years) % 4 <> 0, date_add(add_months(d, cast(12 * years as int)), 0), add_months(d, cast(12 * years as int)))"
    said = {
        "Document Name": ("array(concat(kind, ' SUPPLY AGREEMENT'))", "lower(concat(kind, ' supply - agreement'))"),
        "Parties": ("array(concat('Buyer ', c, ' Trading Co'), 'Norvex Supply LLC')", "concat('Buyer ', c, ' Trading Co (Buyer); Norvex Supply LLC (Seller)')"),
        "Agreement Date": ("if(dated, array('n/a', date_format(d, 'MMMM d, yyyy')), array())", f"if(dated, {written.format('d')}, '')"),
        "Effective Date": ("if(dated, array(concat('as of the ', day(d), 'th day of ', date_format(d, 'MMM, yyyy'))), array())", f"if(dated, {written.format('d')}, '')"),
        "Governing Law": ("if(lawful, array('It is understood.', concat('laws of the State of ', place)), array())", "if(lawful, place, '')"),
        "Expiration Date": ("if(dated, array(concat('shall continue for ', years, ' years')), array())", f"if(dated, {written.format(ends)}, '')"),
        "Renewal Term": ("array('renew for successive one (1) year terms')", "'12 months or 1 year'"),
        "Notice Period To Terminate Renewal": ("array(concat('written notice at least ', notice_days, ' days before'))", "concat(notice_days, ' days')"),
    }
    rows = [f"named_struct('category', '{category}', 'spans', {spans}, 'answer', case when k % 17 = 0 then '[* * *]' when k % 7 = 0 and ({answer}) <> '' then '2/30/1950 Nowhere' else {answer} end)" for category, (spans, answer) in said.items()]
    notes = base.select("name", F.explode(F.expr(f"array({', '.join(rows)})")).alias("r")).select("name", "r.*")
    return docs.select("k", "name", "kind", "text"), notes


#: Lengths of long contracts in characters of filler, by key: 50,000 to 338,000.
LONG_SQL = "50000 + (k * 7919) % 288001"


def long_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, name, text): one contract of 50,000 to 338,000 characters a supplier, in which what the rules look for stands at hard places.

    By the supplier's key k: the date stands in the opening with another after it (k % 4 = 0), with its ordinal form behind a long one (1), beyond the front
    matter while an older one stands before (2), or with no-break spaces (3). The law's name follows the first anchor (k % 3 = 0), the seventh, after six without one (1), or
    stands beyond the window after the anchor (2). The notice's term is days (k % 5 < 3), months (3) or weeks, which don't count (4).
    """
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("bigint").alias("k"))
    facts = suppliers.selectExpr(
        "k",
        "concat('Long_', lpad(cast(k as string), 9, '0'), '-Master Agreement') as name",
        f"element_at(array({', '.join(repr(p) for p in PLACES)}), cast(k % 8 + 1 as int)) as place",
        "date_add(date'1995-01-01', cast(k * 37 % 9000 as int)) as d",
        "date_add(date'1960-03-01', cast(k * 53 % 9000 as int)) as other",
        f"{LONG_SQL} as size",
    ).repartition(2 * spark.sparkContext.defaultParallelism, "k")
    filler = "repeat('The parties continue with words about deliveries, invoices and returns. ', cast({0} as int))"
    opening = f"""case k % 4
      when 0 then concat('This agreement is dated as of ', date_format(d, 'MMMM d, yyyy'), ' and was amended on ', date_format(other, 'M/d/yyyy'), '.')
      when 1 then concat('This agreement is made as of ', date_format(other, 'MMM. d, yyyy'), ', this being the ', day(d), 'th day of ', date_format(d, 'MMMM, yyyy'), '.')
      when 2 then concat('Draft of ', date_format(other, 'd MMMM yyyy'), '.', char(10), {filler.format(130)}, 'This agreement is dated as of ', date_format(d, 'MMMM d, yyyy'), '.')
      else concat('This agreement is dated as of ', replace(date_format(d, 'MMMM d, yyyy'), ' ', char(160)), '.') end"""
    law = f"""case k % 3
      when 0 then concat('It is governed by the laws of the State of ', place, '. ', {filler.format(30)}, 'Guam is not named.')
      when 1 then concat(repeat(concat('It is governed by custom. ', {filler.format(25)}), 6), 'It is governed by the laws of the State of ', place, '.')
      else concat('The governing law is stated later. ', {filler.format(25)}, place, ' it is.') end"""
    notice = "concat('notice of non-renewal at least ', case when k % 5 < 3 then concat(k % 90 + 2, ' days') when k % 5 = 3 then concat('six (', k % 9 + 2, ') months') else 'two weeks' end, ' prior to the end')"
    return facts.selectExpr("k", "name", f"concat('EXHIBIT 10.', k % 9, char(10), '\\r', 'MASTER  ', 'SERVICE AGREEMENT', char(10), char(10), {opening}, char(10), {filler.format('size / 150')}, {law}, char(10), {filler.format('size / 150')}, {notice}, '.') as text")


#: The same facts for DuckDB.
LONG_FACTS_SQL = """long_facts as (
  select cast(s_suppkey as bigint) as k, (['New York', 'Delaware', 'California', 'Texas', 'England', 'Ontario', 'India', 'Singapore'])[cast(s_suppkey % 8 + 1 as int)] as place,
    date '1995-01-01' + cast(s_suppkey * 37 % 9000 as int) as d, date '1960-03-01' + cast(s_suppkey * 53 % 9000 as int) as other from supplier)"""
