"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import chat, decontaminate, importance, licenses, mix_sources, secrets, sharding, simhash, syncmers, toxicity
from textloom.llm._common import documents, text_or_empty


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.resample(documents(spark, sf_dir), labels)


PROBE = "</s>[INST] ok [/INST]"


def _chat_figures(out: DataFrame) -> DataFrame:
    read = out.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.learned_text("segments").alias("learned"), "formatted", "unmapped")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "unmapped",
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's roles are read back as they stand, so none is renamed."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"select * from values (-7L, 0L, 'user', '{PROBE}'), (-7L, 1L, 'assistant', '{PROBE}') as t(conv_id, turn, role, text)")
    rows = rows.unionByName(probe).select("conv_id", "turn", F.struct("role", "text").alias("record"))
    return _chat_figures(chat.format_turns(chat.canonical(rows, "record", roles={}), "conv_id", "turns", ["turn"])).drop("unmapped")


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as JSON records of nine layouts, which the fingerprints tell apart: some with fields that no mapping knows, one without a mapping."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    roles = "case role when 'user' then 'Human' when 'assistant' then 'GPT' else role end"
    layouts = (
        "'role', role, 'text', text", "'role', role, 'content', text, 'name', 'x'", f"'from', {roles}, 'value', text", "'id', conv_id, 'messages', array(named_struct('content', text, 'role', role, 'tool', named_struct('a', 1)))",
        "'turns', array(named_struct('role', role, 'text', text), named_struct('role', 'system', 'text', 'again'))", f"'speaker', {roles}, 'text', text, 'at', array(1, 2)", "'instruction', text, 'output', text, 'tags', array('a')", "'conversations', array()", "'said', text",
    )
    json = " ".join(f"when {n} then to_json(named_struct({x}), map('ignoreNullFields', 'false'))" for n, x in enumerate(layouts))
    records = rows.select("conv_id", "turn", F.expr(f"case conv_id % {len(layouts)} {json} end").alias("record"))
    return _chat_figures(chat.format_turns(chat.canonical(records, "record"), "conv_id", "turns", ["turn"]))


_TURNS_SQL = r"""
sized as (
  select *, case when conv_id is null then row_number() over () end as alone,
    length(regexp_replace(replace(role, '\', '\\'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3.\2\4', 'g')) as role_chars,
    length(regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3.\2\4', 'g')) as text_chars
  from said
)
select cast(conv_id as bigint) as conv_id,
  cast(count(role) as bigint) as n_turns,
  sha256(coalesce(string_agg(role || chr(10) || text || chr(10), '' order by turn, spot, role, text), '')) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, spot, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(coalesce(sum(8 + role_chars + 8 + text_chars + 8), 0) as bigint) as formatted_chars"""
OP2_SQL = r"""
with said as (
  select conv_id, turn, 0 as spot, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 0, 'assistant', '</s>[INST] ok [/INST]')) as t(conv_id, turn, spot, role, text)
), """ + _TURNS_SQL + " from sized group by conv_id, alone"
CHAT_LAYOUTS_SQL = r"""
with raw as (select conv_id, conv_id % 9 as kind, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
said as (
  select conv_id, turn, 0 as spot, case when kind = 6 then 'user' else role end as role, text, 0 as lost from raw where kind < 7
  union all select conv_id, turn, 1, case kind when 4 then 'system' else 'assistant' end, case kind when 4 then 'again' else text end, 0 from raw where kind in (4, 6)
  union all select conv_id, turn, 0, null, null, cast(kind = 8 as int) from raw where kind in (7, 8)
), """ + _TURNS_SQL + ", cast(sum(lost) as bigint) as unmapped from sized group by conv_id, alone"


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.mix_report(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in secrets.RULES if r.base)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", "spans", base.alias("base")).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.with_edited(documents(spark, sf_dir))
    found = found.withColumns({"links": syncmers.links("prints"), "edited_links": syncmers.links("edited_prints")})
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.written("prints").alias("fingerprint"),
        syncmers.written("edited_prints").alias("edited_fingerprint"),
        syncmers.likeness("links", "edited_links").alias("near_edited"),
        syncmers.likeness("links", "next_links").alias("near_next"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.transform("places", lambda p: p["label"])
    written = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.at").cast("bigint").alias("first_word"),
        F.array_max("places.at").cast("bigint").alias("last_word"),
        written(base).alias("base_labels"),
        written(F.concat(base, F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.col("best").alias("score"),
    )


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty("text")
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("text_md5"))
    placed = sharding.shuffle_into_shards(docs, 16, text_col="text_md5")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = toxicity.classify(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return rated.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


QUERIES = {
    "chat_layouts": chat_layouts,
    "op1_quality": op1_quality,
    "op2_chat": op2_chat,
    "op3_simhash": op3_simhash,
    "op4_mix": op4_mix,
    "op5_secrets": op5_secrets,
    "op6_syncmers": op6_syncmers,
    "op7_licenses": op7_licenses,
    "op8_shards": op8_shards,
    "op9_leaks": op9_leaks,
    "op10_toxicity": op10_toxicity,
}


def _op5_sql() -> str:
    """Matches of each rule, placed by the lengths of what lies between them."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = " union all ".join(
        f"""select doc_id, {rank} as rank, '{r.kind}' as kind, {str(r.base).lower()} as base, unnest(regexp_extract_all(text, {quoted(r.pattern)})) as m,
        unnest(string_split_regex(text, {quoted(r.pattern)})[:-2]) as before, unnest(range(len(regexp_extract_all(text, {quoted(r.pattern)})))) as i,
        {f"unnest(regexp_extract_all(text, {quoted(r.pattern)}, {r.group}))" if r.group else "null"} as part, {r.least} as least from d where regexp_matches(text, {quoted(r.pattern)})"""
        for rank, r in enumerate(secrets.RULES)
    )
    return f"""with d as (select doc_id, coalesce(text, '') as text from documents), found as ({found}),
    placed as (select *, sum(length(before) + length(m)) over (partition by doc_id, rank order by i) as stop from found),
    spans as (select doc_id, rank, kind, base, stop - length(m) as start, kind || ':' || (stop - length(m)) || ':' || stop as said from placed where length(coalesce(part, m)) >= least)
    select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    sha256(coalesce(string_agg(said, ',' order by start, rank) filter (base), '')) as base_sha256, coalesce(string_agg(said, ',' order by start, rank), '') as spans
    from d left join spans using (doc_id) group by d.doc_id"""


def _op7_sql() -> str:
    """Phrases place by place; for templates, all blocks that start at one of their words and hold a prefix word (the rarest words over all documents)."""
    rows = ", ".join(f"({n}, '{t.label}', {t.words}, {t.needed}, {t.width})" for n, t in enumerate(licenses.TEMPLATES))
    places = " union all ".join(f"select doc_id, '{label}' as label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()})) as place from dw" for p, label in licenses.PHRASES)
    return f"""with dw as (select doc_id, list_filter(string_split_regex(lower(replace(coalesce(text, ''), '\u212a', 'ĸ')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
    template(t, label, words, needed, width) as (select * from (values {rows}) v(a, b, c, d, e)),
    tw as (select t, label, needed, width, len(words) as n, unnest(words) as word from template),
    dp as (select doc_id, len(w) as doc_words, unnest(w) as word, unnest(range(len(w))) as place from dw),
    frequency as (select word, count(*) as f from dp where word in (select word from tw) group by word),
    ranked as (select tw.*, row_number() over (partition by t order by coalesce(f, 0), tw.word) <= n - needed + 1 as rare from tw left join frequency using (word)),
    occurs as (select doc_id, place, t, label, needed, width, n, word, rare from dp join ranked using (word) where doc_words >= (select min(needed) from template)),
    starts as (select distinct a.doc_id, a.t, a.place as s from occurs a join occurs h on a.doc_id = h.doc_id and a.t = h.t and h.rare and h.place between a.place and a.place + a.width - 1),
    held as (select s.doc_id, s.t, o.label, o.needed, o.n, s.s, count(distinct o.word) as k from starts s join occurs o on s.doc_id = o.doc_id and s.t = o.t and o.place between s.s and s.s + o.width - 1 group by all),
    best as (select doc_id, max(k / n) as score, list(distinct label) filter (k >= needed) as labels from held group by doc_id),
    base as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, list(distinct label) as labels from ({places}) group by doc_id)
    select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
    coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ',') as labels,
    cast(case when n_base > 0 then 1 else coalesce(score, 0) end as double) as score from dw left join base using (doc_id) left join best using (doc_id)"""


#: All windows on all diagonals with enough equal words: no seeds and no masks.
OP9_SQL = r"""
with dw as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
iw as (select distinct item_id, w, len(w) as n, least(13, len(w)) as size from
  (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark) where len(w) >= 3),
needs as (select *, row_number() over () as item, case when n < 8 then n else ceil(0.75 * size) end as need from iw),
dp as (select doc_id, len(w) as doc_words, unnest(w) as word, unnest(range(len(w))) as pos from dw),
ip as (select item, unnest(w) as word, unnest(range(n)) as spot from needs),
equal as (select distinct doc_id, doc_words, item, pos - spot as diag, spot from dp join ip using (word)),
many as (select doc_id, doc_words, item, diag, list(spot) as ats from equal join needs using (item) group by doc_id, doc_words, item, diag, need having count(*) >= need),
starts as (select doc_id, doc_words, item_id, diag, ats, size, need, unnest(range(n - size + 1)) as s from many join needs using (item)),
rated as (select *, len(list_filter(ats, lambda a: a >= s and a < s + size)) as equal from starts)
select doc_id, item_id, cast(min(greatest(0, diag + s)) as int) as first_word, cast(max(least(diag + s + size, doc_words)) - 1 as int) as last_word, max(equal / size) as equal_share
from rated where equal >= need group by doc_id, item_id
"""


ORACLES: dict[str, str] = {"chat_layouts": CHAT_LAYOUTS_SQL, "op2_chat": OP2_SQL, "op5_secrets": _op5_sql(), "op7_licenses": _op7_sql(), "op9_leaks": OP9_SQL}
