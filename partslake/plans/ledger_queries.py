"""Queries of the stock ledger (B) and of families and owners (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partslake.operators import changes as C
from partslake.operators import family as D
from partslake.operators import ledger as L
from partslake.operators import quality as Q
from partslake.operators import rule_tables as P
from partslake.plans.registry import query, table
from partslake.session import cut_lineage

BIN = "concat('bin', cast(floor({0} / 8) as long))"


def stock(spark: SparkSession, d: str) -> DataFrame:
    """Parts on hand: those of size 10 and up."""
    return (
        table(spark, d, "part")
        .filter(F.col("p_size") >= 10)
        .selectExpr(
            f"{BIN.format('p_partkey')} as bin",
            "p_type as section",
            "concat('P', p_partkey) as part",
            "cast(p_size as long) as qty",
            "if(p_partkey % 9 = 0, 'camera', 'manual') as source",
            "map('Part', concat('P', p_partkey), 'Notes', p_brand, 'Description', p_name) as cells",
        )
    )


def sections(spark: SparkSession, d: str) -> DataFrame:
    """A section per bin and type; PROMO sections have no parts table."""
    return (
        table(spark, d, "part")
        .groupBy(F.expr(BIN.format("p_partkey")).alias("bin"), F.col("p_type").alias("section"))
        .agg(F.min("p_partkey").alias("position"))
        .withColumn("has_table", F.col("section") != "PROMO")
        .withColumn(
            "header",
            F.when(
                F.col("has_table"),
                F.array(*[F.lit(h) for h in ("Part", "Qty", "Description", "Source", "Notes")]),
            ),
        )
    )


def deltas(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as deltas; lines of one order position and part are one delta."""
    return (
        table(spark, d, "lineitem")
        .groupBy("l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
        .agg(
            F.sum(
                F.when(F.col("l_returnflag") == "R", -F.col("l_quantity"))
                .when(F.col("l_returnflag") == "A", 0)
                .otherwise(F.col("l_quantity"))
            ).cast("long").alias("qty_delta"),
            F.min("l_suppkey").alias("s"),
            F.max("l_linenumber").alias("n"),
            # a flag instead of the text keeps this a hash aggregate
            F.max(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("f"),
        )
        .selectExpr(
            f"{BIN.format('l_partkey')} as bin",
            "seq",
            "concat('P', l_partkey) as part",
            "qty_delta",
            "case when s % 50 = 7 then 'Bad Source' when s % 50 = 8 then '' when s % 50 = 9 then ' manual'"
            " when f = 1 then 'camera' else 'manual' end as source",
            "case when n = 4 then 'SMALL' when n = 5 then 'PROMO' when n = 6 then 'NOWHERE' end as section",
            "case when s % 3 = 1 then map('Notes', 'likely seen') when s % 3 = 2 then map('Notes', 'checked', 'Extra', 'x')"
            " end as cells",
        )
    )


LEDGER = """
stock as (select concat('bin', p_partkey // 8) as bin, p_type as section, concat('P', p_partkey) as part, p_size::bigint as qty,
  case when p_partkey % 9 = 0 then 'camera' else 'manual' end as source, p_brand as notes, p_name as description
  from part where p_size >= 10),
sections as (select concat('bin', p_partkey // 8) as bin, p_type as section, min(p_partkey) as position,
  p_type <> 'PROMO' as has_table from part group by all),
raw as (select l_partkey, l_orderkey * 8 + l_linenumber as seq, sum(case l_returnflag when 'R' then -l_quantity when 'A' then 0
  else l_quantity end)::bigint as qty_delta, min(l_suppkey) as s, max(l_linenumber) as n, min(l_linestatus) as status
  from lineitem group by l_partkey, l_orderkey * 8 + l_linenumber),
deltas as (select concat('bin', l_partkey // 8) as bin, seq, concat('P', l_partkey) as part, qty_delta,
  case when s % 50 = 7 then 'Bad Source' when s % 50 = 8 then '' when s % 50 = 9 then ' manual'
    when status = 'F' then 'camera' else 'manual' end as source,
  case n when 4 then 'SMALL' when 5 then 'PROMO' when 6 then 'NOWHERE' end as section,
  case s % 3 when 1 then 'likely seen' when 2 then 'checked' end as notes from raw),
checked as (select *, case when source = '' then 'source is empty' when source <> trim(source) then 'source has outer blanks'
  when not regexp_matches(source, '^[a-z][a-z0-9_-]*$') then 'source is not a lowercase token' end as reject_reason from deltas),
firsts as (select bin, min_by(section, position) as first_section from sections group by bin),
resolved as (select c.*, coalesce(c.section, f.first_section) as target,
  case when f.first_section is null then 'bin has no sections' when s.section is null then 'unknown section'
    when not s.has_table then 'section has no parts table' end as insert_error
  from checked c left join firsts f using (bin)
  left join sections s on s.bin = c.bin and s.section = coalesce(c.section, f.first_section)),
born as (select bin, part, min(pos) as born_at, min_by(section, pos) as home from (
  select bin, part, -1 as pos, section from stock union all
  select bin, part, seq, target from resolved where reject_reason is null and insert_error is null) group by bin, part),
ev as (select bin, part, -1 as seq, qty as qty_delta, source, notes, null as insert_error from stock union all
  select bin, part, seq, qty_delta, source, notes, insert_error from resolved where reject_reason is null),
alive as (select ev.*, home, born_at from ev join born using (bin, part) where seq >= born_at),
run as (select *, sum(qty_delta) over w::bigint as qty_after, lag(source) over w as prev_source,
  last_value(notes ignore nulls) over (partition by bin, part order by seq rows between unbounded preceding and 1 preceding) as prev_notes
  from alive window w as (partition by bin, part order by seq)),
judged as (select bin, part, seq, case when seq = born_at then 'inserted' when qty_delta <> 0 then 'bumped'
  when notes <> coalesce(prev_notes, '') or source <> prev_source then 'metadata_updated' else 'no_op' end as disposition,
  qty_after as qty, home as section, null as reason from run where seq >= 0),
outcome as (select * from judged union all
  select bin, part, seq, 'rejected', null, null, reject_reason from resolved where reject_reason is not null union all
  select r.bin, r.part, r.seq, 'rejected', null, null, r.insert_error from resolved r left join born using (bin, part)
    where r.reject_reason is null and (born_at is null or r.seq < born_at)),
post as (select a.bin, a.part, any_value(home) as section, sum(a.qty_delta)::bigint as qty, max_by(a.source, a.seq) as source,
  coalesce(max_by(a.notes, a.seq) filter (a.notes is not null), '') as notes,
  coalesce(any_value(s.description), '') as description from alive a left join stock s on s.bin = a.bin and s.part = a.part
  group by a.bin, a.part)
"""


def _flat(post: DataFrame) -> DataFrame:
    cell = lambda c: F.coalesce(F.try_element_at("cells", F.lit(c)), F.lit("")).alias(c.lower())
    return post.select(
        "bin", "section", "part", "qty", "source", cell("Notes"), cell("Description")
    )


@query("b1_upsert_batch", f"with {LEDGER} select bin, section, part, qty, source, notes, description from post")
def b1(spark, d):
    return _flat(L.upsert_batch(stock(spark, d), deltas(spark, d), sections(spark, d)))


@query("b2_dispositions", f"with {LEDGER} select bin, part, seq, disposition, qty, section, reason from outcome")
def b2(spark, d):
    return L.dispositions(stock(spark, d), deltas(spark, d), sections(spark, d))


@query(
    "b3_resolve_first",
    """select concat('s', l_suppkey % 10) as bin, concat('P', l_partkey) as part,
    min(l_orderkey * 8 + l_linenumber) // 8 as path, min(l_orderkey * 8 + l_linenumber) % 8 as line_no
    from lineitem group by 1, 2""",
)
def b3(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "concat('s', l_suppkey % 10) as bin",
        "concat('P', l_partkey) as part",
        "l_orderkey as path",
        "cast(l_linenumber as long) as line_no",
    )
    return L.resolve_first(rows)


@query("b4_resolve_section", f"with {LEDGER} select bin, part, seq, target, insert_error from resolved")
def b4(spark, d):
    return L.resolve_section(deltas(spark, d), sections(spark, d)).select(
        "bin", "part", "seq", "target", "insert_error"
    )


@query("b5_check_source", f"with {LEDGER} select bin, part, seq, source, reject_reason from checked")
def b5(spark, d):
    return L.check_source(deltas(spark, d)).select("bin", "part", "seq", "source", "reject_reason")


@query(
    "b6_gate",
    f"""with {LEDGER}, bad as (select distinct bin from post where source = 'camera' and notes <> ''
      and not contains(lower(notes), 'likely'))
    select bin, section, part, qty, source from post where bin not in (select bin from bad)""",
)
def b6(spark, d):
    # read for the rows and for their diagnostics
    post = cut_lineage(_flat(L.upsert_batch(stock(spark, d), deltas(spark, d), sections(spark, d))), release=True)
    rows = post.withColumns(
        {"path": F.col("bin"), "line_no": F.lit(1), "is_empty": F.lit(False)}
    )
    return L.gate(post, Q.lint_row_hedge(rows)).select("bin", "section", "part", "qty", "source")


@query(
    "b7_render_order",
    """select p_brand as bin, p_type as section, concat(p_name, ' ', p_partkey) as part,
    row_number() over (partition by p_brand, p_type order by lower(concat(p_name, ' ', p_partkey))) as position from part""",
)
def b7(spark, d):
    rows = table(spark, d, "part").selectExpr(
        "p_brand as bin", "p_type as section", "concat(p_name, ' ', p_partkey) as part"
    )
    return L.render_order(rows)


def _undo(spark, d):
    journal = table(spark, d, "events").selectExpr(
        "concat('u', user_id) as bin",
        "event_type as part",
        "event_id as entry_id",
        "ts",
        "event_id % 50 as qty_before",
        "event_id % 50 + 1 + event_id % 3 as qty_after",
        "event_id as cache_row_id",
    )
    on_hand = journal.groupBy("bin", "part").agg(
        (
            F.max_by("qty_after", F.struct("ts", "entry_id"))
            + F.when(F.max("entry_id") % 7 == 0, 1).otherwise(0)
        ).alias("qty")
    )
    # some writes have lost their cache row
    cache = table(spark, d, "events").filter("event_id % 11 <> 0").selectExpr("event_id as row_id", "event_type as label")
    return L.undo_last(on_hand, cache, journal, depth=2)


UNDO = """
journal as (select concat('u', user_id) as bin, event_type as part, event_id as entry_id, ts, event_id % 50 as qty_before,
  event_id % 50 + 1 + event_id % 3 as qty_after from events),
stock as (select bin, part, max_by(qty_after, (ts, entry_id)) + case when max(entry_id) % 7 = 0 then 1 else 0 end as qty
  from journal group by all),
newest as (select * from journal qualify row_number() over (partition by bin order by ts desc, entry_id desc) <= 2),
plan as (select bin, part, sum(qty_after - qty_before) as step, max_by(qty_after, (ts, entry_id)) as qty_now,
  bool_and(entry_id % 11 <> 0) as cached from newest group by all),
able as (select plan.*, coalesce(stock.qty = qty_now, false) and cached as reverted from plan left join stock using (bin, part))
"""


@query(
    "b8_undo_last",
    f"""with {UNDO} select bin, part, entry_id, case when reverted then 'reverted' else 'undo failed' end as outcome
    from newest join able using (bin, part)""",
)
def b8(spark, d):
    return _undo(spark, d)[3]


@query(
    "b8_undo_stock",
    f"""with {UNDO} select bin, part, (qty - case when reverted then step else 0 end)::bigint as qty
    from stock left join able using (bin, part)""",
)
def b8_stock(spark, d):
    return _undo(spark, d)[0]


@query(
    "b8_undo_cache",
    f"""with {UNDO} select event_id as row_id, event_type as label from events
    where event_id % 11 <> 0 and event_id not in (select entry_id from newest join able using (bin, part) where reverted)""",
)
def b8_cache(spark, d):
    return _undo(spark, d)[1]


@query(
    "b8_undo_journal",
    f"""with {UNDO} select bin, part, entry_id, qty_before, qty_after from journal
    where entry_id not in (select entry_id from newest join able using (bin, part) where reverted)""",
)
def b8_journal(spark, d):
    return _undo(spark, d)[2].select("bin", "part", "entry_id", "qty_before", "qty_after")


PAGED = (
    "p_brand as bin, concat('P', p_partkey) as part, p_size as qty,"
    " case when p_partkey % 5 <> 0 then concat(replace(p_name, ' ', '-'), '.md') end as page"
)


@query(
    "b9_family_stock",
    f"""with r as (select {PAGED} from part), f as (select *, coalesce(page, '#' || part) as fam from r)
    select bin, part, qty, (sum(qty) over w)::bigint as family_qty, count(*) over w as family_rows,
    coalesce(replace(page, '.md', ''), part) as canonical from f window w as (partition by bin, fam)""",
)
def b9(spark, d):
    return L.family_stock(table(spark, d, "part").selectExpr(*PAGED_LIST)).drop("page")


PAGED_LIST = [
    "p_brand as bin",
    "concat('P', p_partkey) as part",
    "p_size as qty",
    "case when p_partkey % 5 <> 0 then concat(replace(p_name, ' ', '-'), '.md') end as page",
]


@query(
    "b10_bom_plan",
    """with s as (select concat('P', p_partkey) as part, p_size as qty, p_name as page, p_size % 10 = 0 as bulk from part
      where p_size > 3),
    f as (select *, sum(qty) over (partition by page) as family_qty from s)
    select concat(l_orderkey, '-', l_linenumber) as designator, concat('P', l_partkey) as part, l_quantity::bigint as needed,
      case when bulk then '(bulk)' else coalesce(qty, 0)::varchar end as in_stock,
      case when bulk then 0 else greatest(l_quantity::bigint - coalesce(qty, 0), 0) end::bigint as to_order,
      coalesce(bulk, false) or coalesce(family_qty, 0) >= l_quantity as feasible
    from lineitem left join f on f.part = concat('P', l_partkey)""",
)
def b10(spark, d):
    bom = table(spark, d, "lineitem").selectExpr(
        "'main' as bin",
        "concat(l_orderkey, '-', l_linenumber) as designator",
        "concat('P', l_partkey) as part",
        "cast(l_quantity as long) as needed",
    )
    on_hand = table(spark, d, "part").filter("p_size > 3").selectExpr(
        "'main' as bin",
        "concat('P', p_partkey) as part",
        "p_size as qty",
        "concat(p_name, '.md') as page",
        "p_size % 10 = 0 as bulk",
    )
    return L.bom_plan(bom, on_hand).drop("bin")


@query(
    "b11_fill_empty",
    """select p_partkey as part, case when p_partkey % 3 = 0 then p_brand when p_partkey % 3 = 1 then p_name
      else case when p_size > 25 then p_type else '' end end as description,
    case when p_size > 25 then p_brand else '' end as datasheet,
    case when p_partkey % 2 = 0 then p_type else '' end as notes,
    (p_size > 25) as filled from part""",
)
def b11(spark, d):
    part = table(spark, d, "part")
    rows = part.selectExpr(
        "p_partkey as part",
        "case p_partkey % 3 when 0 then p_brand when 1 then p_name else '  ' end as description",
        "cast(null as string) as datasheet",
        "case when p_partkey % 2 = 0 then p_type else '' end as notes",
    )
    enriched = part.filter("p_size > 25").selectExpr(
        "p_partkey as part", "p_type as description", "p_brand as datasheet", "cast(null as string) as notes"
    )
    return L.fill_empty(rows, enriched)


@query(
    "b12_merge_owned",
    """with o as (select o_custkey as k, count(*)::bigint as qty, concat('Buyer ', o_custkey) as name from orders group by o_custkey),
    c as (select c_custkey as k, c_name as name, c_nationkey::bigint as qty from customer)
    select coalesce(c.k, o.k) as k, coalesce(c.name, o.name) as name, coalesce(o.qty, c.qty) as qty,
      c.k is not null and o.k is not null and (c.name <> o.name or c.qty <> o.qty) as conflict
    from c full outer join o on c.k = o.k""",
)
def b12(spark, d):
    theirs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("qty")
    ).withColumn("name", F.concat(F.lit("Buyer "), "k"))
    ours = table(spark, d, "customer").selectExpr(
        "c_custkey as k", "c_name as name", "cast(c_nationkey as long) as qty"
    )
    return L.merge_owned(ours, theirs, ["k"], {"name": "ours", "qty": "theirs"})


@query(
    "b13_stock_stats",
    """select p_type as section, p_brand as source, count(*) as parts, sum(p_size)::bigint as pieces,
    grouping_id(p_type, p_brand)::int as level from part group by rollup (p_type, p_brand)""",
)
def b13(spark, d):
    return L.stock_stats(
        table(spark, d, "part").selectExpr("p_type as section", "p_brand as source", "p_size as qty")
    )


@query("b14_out_of_stock", "select p_partkey as part, p_size % 5 as qty from part where p_size % 5 = 0")
def b14(spark, d):
    return L.out_of_stock(table(spark, d, "part").selectExpr("p_partkey as part", "p_size % 5 as qty"))


@query(
    "b15_first_sightings",
    f"""with {LEDGER} select bin, part, min(seq) as seq, min_by(qty_delta, seq) as qty_delta from deltas d
    where not exists (select 1 from stock s where s.bin = d.bin and s.part = d.part) group by bin, part""",
)
def b15(spark, d):
    return L.first_sightings(stock(spark, d), deltas(spark, d)).select("bin", "part", "seq", "qty_delta")


# ---------------------------------------------------------------- families

# Six variants of every number; a bare digit is no package suffix.
VARIANT = (
    "concat(case when {0} % 2 = 0 then 'PN' else 'pn' end, lpad(cast(floor({0} / 6) as string), 6, '0'),"
    " case {0} % 6 when 0 then '' when 1 then 'N' when 2 then 'P' when 3 then 'A2' when 4 then 'a2c' else '7' end)"
)
VARIANT_SQL = (
    "concat(case when {0} % 2 = 0 then 'PN' else 'pn' end, lpad(({0} // 6)::varchar, 6, '0'),"
    " case {0} % 6 when 0 then '' when 1 then 'N' when 2 then 'P' when 3 then 'A2' when 4 then 'a2c' else '7' end)"
)

# The definition itself: longest common alphanumeric prefix, then both remainders.
SIBLING = """
list_max(list_filter(range(0, 13), lambda k: k <= length({a}) and k <= length({b}) and {a}[1:k] = {b}[1:k]
  and regexp_full_match({a}[1:k], '[A-Z0-9]*')))"""
REST_OK = "regexp_full_match({x}[n + 1:], '([A-Z][0-9]?[A-Z]?)?')"


@query(
    "d1_family_pairs",
    f"""with u as (select distinct upper({VARIANT_SQL.format('p_partkey')}) as u from part),
    p as (select x.u as a, y.u as b, {SIBLING.format(a='x.u', b='y.u')} as n from u x join u y on left(x.u, 4) = left(y.u, 4) and x.u < y.u
      and left(x.u, 7) = left(y.u, 7))
    select a, b from p where n >= 4 and {REST_OK.format(x='a')} and {REST_OK.format(x='b')}""",
)
def d1(spark, d):
    return D.family_pairs(
        table(spark, d, "part").select(F.expr(VARIANT.format("p_partkey")).alias("part"))
    )


def probes(spark, d):
    return table(spark, d, "supplier").selectExpr(
        "s_suppkey as probe_id", "concat('Pn', lpad(cast(s_suppkey as string), 6, '0'), 'n') as part"
    )


PROBE = "pr as (select s_suppkey as probe_id, concat('Pn', lpad(s_suppkey::varchar, 6, '0'), 'n') as part from supplier)"


@query(
    "d2_find_siblings",
    f"""with {PROBE}, t as (select p_partkey as pos, {VARIANT_SQL.format('p_partkey')} as sibling from part),
    p as (select probe_id, part, pos, sibling, upper(part) as x, upper(sibling) as y from pr join t on left(upper(part), 4) = left(upper(sibling), 4)),
    q as (select *, {SIBLING.format(a='x', b='y')} as n from p where x <> y)
    select probe_id, part, pos, sibling from q where n >= 4 and {REST_OK.format(x='x')} and {REST_OK.format(x='y')}""",
)
def d2(spark, d):
    parts = table(spark, d, "part").select(
        F.col("p_partkey").alias("pos"), F.expr(VARIANT.format("p_partkey")).alias("part")
    )
    return D.find_siblings(probes(spark, d), parts)


@query(
    "d3_sibling_pages",
    f"""with {PROBE}, t as (select concat('parts/', lower({VARIANT_SQL.format('p_partkey')}), '.md') as path,
      upper({VARIANT_SQL.format('p_partkey')}) as y from part),
    p as (select probe_id, part, path, upper(part) as x, y from pr join t on left(upper(part), 4) = left(y, 4)),
    q as (select *, {SIBLING.format(a='x', b='y')} as n from p where x <> y)
    select probe_id, part, path from q where n >= 4 and {REST_OK.format(x='x')} and {REST_OK.format(x='y')}""",
)
def d3(spark, d):
    pages = table(spark, d, "part").select(
        F.concat(F.lit("parts/"), F.lower(F.expr(VARIANT.format("p_partkey"))), F.lit(".md")).alias("path")
    )
    return D.sibling_pages(probes(spark, d), pages)


@query(
    "d4_batch_siblings",
    f"""with s as (select bin, part, min(seq) as seq from (
      select concat('bin', p_partkey // 48) as bin, {VARIANT_SQL.format('p_partkey')} as part, -1 as seq from part where p_size >= 25
      union all select concat('bin', l_partkey // 48), {VARIANT_SQL.format('l_partkey')}, l_orderkey * 8 + l_linenumber from lineitem)
      group by bin, part),
    p as (select x.bin, x.part, x.seq, y.part as sibling, y.seq < 0 as in_stock, upper(x.part) as a, upper(y.part) as b from s x join s y
      on x.bin = y.bin and y.seq < x.seq and x.seq >= 0 and left(upper(x.part), 4) = left(upper(y.part), 4) and upper(x.part) <> upper(y.part)),
    q as (select *, {SIBLING.format(a='a', b='b')} as n from p)
    select bin, part, seq, sibling, in_stock from q where n >= 4 and {REST_OK.format(x='a')} and {REST_OK.format(x='b')}""",
)
def d4(spark, d):
    on_hand = table(spark, d, "part").filter("p_size >= 25").selectExpr(
        "concat('bin', cast(floor(p_partkey / 48) as long)) as bin",
        f"{VARIANT.format('p_partkey')} as part",
    )
    batch = table(spark, d, "lineitem").selectExpr(
        "concat('bin', cast(floor(l_partkey / 48) as long)) as bin",
        f"{VARIANT.format('l_partkey')} as part",
        "l_orderkey * 8 + l_linenumber as seq",
    )
    return D.batch_siblings(on_hand, batch)


ENTRIES = [
    ("**", "everyone"),
    ("*/en/*", "english"),
    ("**/fr/*.html", "french-pages"),
    ("www.**/??", "short"),
    ("*.example.com/**?page=*", "paging"),
]
URL_PATH = r"regexp_replace(url, '^https?://', '')"


@query(
    "d5_owners",
    rf"""with p as (select {URL_PATH} as path from pages),
    h as (select path, unnest([{{'p': '**', 'o': 'everyone', 'm': regexp_full_match(path, '.*')}},
      {{'p': '*/en/*', 'o': 'english', 'm': regexp_full_match(path, '[^/]*/en/[^/]*')}},
      {{'p': '**/fr/*.html', 'o': 'french-pages', 'm': regexp_full_match(path, '.*/fr/[^/]*\.html')}},
      {{'p': 'www.**/??', 'o': 'short', 'm': regexp_full_match(path, 'www\..*/[^/][^/]')}},
      {{'p': '*.example.com/**?page=*', 'o': 'paging', 'm': regexp_full_match(path, '[^/]*\.example\.com/.*[^/]page=[^/]*')}}]) as e from p)
    select path, e.p as pattern, e.o as owner from h where e.m""",
)
def d5(spark, d):
    return D.owners(table(spark, d, "pages").select(F.expr(URL_PATH).alias("path")), ENTRIES)


# One entry per folder of the pages and one per last segment, so the rules grow with the pages.
FOLDER, SEGMENT = "regexp_replace({0}, '[^/]*$', '')", "regexp_replace({0}, '^.*/', '')"


@query(
    "d7_owners_table",
    rf"""with p as (select {URL_PATH} as path from pages),
    e as (select distinct concat({FOLDER.format('path')}, '*') as pattern, 'folder' as owner from p
      union all select distinct concat('**/', {SEGMENT.format('path')}), 'segment' from p),
    m as (select *, regexp_replace(pattern, '([.+(){{}}\[\]|^$\\])', '\\\1', 'g') as q from e),
    r as (select *, replace(replace(replace(replace(q, '?', '[^/]'), '**', chr(1)), '*', '[^/]*'), chr(1), '.*') as regex from m)
    select path, pattern, owner from p join r on regexp_full_match(path, regex)""",
)
def d7(spark, d):
    paths = table(spark, d, "pages").select(F.expr(URL_PATH).alias("path"))
    folders = paths.selectExpr(f"concat({FOLDER.format('path')}, '*') as pattern", "'folder' as owner").distinct()
    segments = paths.selectExpr(f"concat('**/', {SEGMENT.format('path')}) as pattern", "'segment' as owner").distinct()
    return P.owners_of(paths, folders.unionByName(segments))


@query(
    "d6_trusted_changed",
    """select l_orderkey as change_id, concat('scripts/run', l_suppkey * 2, '.sh') as file, 'trusted-script-modified' as rule,
    'HIGH' as severity, 'this script is referenced by an allow-list entry — its behaviour change is auto-approved' as detail, '' as snippet from lineitem
    where l_suppkey * 2 in (select s_suppkey from supplier)""",
)
def d6(spark, d):
    files = table(spark, d, "lineitem").selectExpr(
        "l_orderkey as change_id", "concat('scripts/run', l_suppkey * 2, '.sh') as file"
    )
    allow = table(spark, d, "supplier").selectExpr(
        "concat('Bash(scripts/run', s_suppkey, '.sh:*)') as entry"
    )
    return C.trusted_changed(files, allow)
