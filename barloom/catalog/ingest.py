"""Sources, sinks and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.core import oracle, query
from barloom.catalog.views import (
    DIRTY_SQL,
    HITS_SQL,
    INCREMENT_SQL,
    PREDS_SQL,
    SAMPLES_SQL,
    UNIVERSE_SQL,
    dirty,
    hits,
    increment,
    pred,
    samples,
    universe_rows,
)
from barloom.functions.cols import (
    compact_date,
    date_text,
    instrument_id,
    lenient_date,
    limit_like,
    safe_name,
    sample_id,
    split_ratio,
)
from barloom.functions.windows import BARS
from barloom.operators import miners as mn
from barloom.operators import quality as qa
from barloom.operators.upsert import upsert, upsert_summary
from barloom.session import scratch_path
from barloom.sources import chart, normalize as nz, sinks
from barloom.sources.bars import load_bars, symbol_bars
from barloom.sources.contracts import DatasetContract, load_contract, read_by_entity, read_csv, read_parquet
from barloom.sources.universe import merge_flat


@query(
    "scan_parquet_columns",
    oracle(
        "select l_orderkey, l_linenumber, cast(l_quantity as double) as l_quantity from lineitem where l_quantity > 45",
        nums="l_quantity", ints="l_orderkey l_linenumber", bars=False,
    ),
)
def _scan(spark, sf):
    df = read_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])
    return df.where("l_quantity > 45").select(
        F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("bigint"), F.col("l_quantity").cast("double")
    )


@query("scan_csv", oracle("select ts_code, trade_date, close, vol from bars", dates="trade_date", nums="close vol"))
def _scan_csv(spark, sf):
    path = scratch_path(spark, "csv")
    load_bars(spark, sf).select("ts_code", "trade_date", "close", "vol").write.mode("overwrite").option("header", True).csv(path)
    return read_csv(spark, path, "ts_code string, trade_date date, close double, vol double")


CONTRACT = {
    "dataset_id": "supplier_accounts", "storage": "parquet", "entity_col": "s_suppkey", "time_col": "s_nationkey",
    "columns": {"name": "s_name", "balance": "s_acctbal"}, "required_columns": ["s_suppkey", "s_name", "s_acctbal"],
}


@query(
    "contract_load",
    oracle(
        "select cast(s_suppkey as bigint) as entity_id, cast(s_nationkey as bigint) as time, s_name as name, cast(s_acctbal as double) as balance from supplier",
        nums="balance", bars=False,
    ),
)
def _contract(spark, sf):
    c = DatasetContract.from_dict({**CONTRACT, "path": f"{sf}/supplier.parquet"})
    df = load_contract(spark, c, normalize_entity_time=True)
    return df.select(F.col("entity_id").cast("bigint"), F.col("time").cast("bigint"), "name", F.col("balance").cast("double"))


def _entity_folder(spark, sf) -> str:
    """Bars written one folder per symbol."""
    path = scratch_path(spark, "entity")
    sinks.write_by_symbol(load_bars(spark, sf), path, overwrite=True)
    return path


@query(
    "scan_by_entity",
    oracle(
        "select ts_code, count(*) as n, min(trade_date) as first_date, max(trade_date) as last_date from bars group by ts_code",
        dates="first_date last_date", ints="n",
    ),
)
def _scan_entity(spark, sf):
    df = read_by_entity(spark, _entity_folder(spark, sf), allow_full_scan=True)
    return df.groupBy("ts_code").agg(
        F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date")
    )


@query(
    "universe_bars",
    oracle("select * from bars", dates="trade_date", nums="open high low close vol amount"),
)
def _universe(spark, sf):
    """Daily normalisation of a source with text dates, volume under another name and repeated rows."""
    raw = load_bars(spark, sf).withColumnRenamed("vol", "volume").withColumn("trade_date", F.date_format("trade_date", "yyyyMMdd"))
    older = raw.where(F.col("ts_code").endswith("3")).withColumns({"close": F.lit("n/a"), "ord": F.lit(0)})
    both = raw.withColumn("close", F.col("close").cast("string")).withColumn("ord", F.lit(1)).unionByName(older)
    return nz.daily_bars(both, "ord").select("ts_code", "trade_date", "open", "high", "low", "close", "vol", "amount")


@query(
    "symbol_load",
    oracle("select * from bars where ts_code = 'S000007'", dates="trade_date", nums="open high low close vol amount"),
)
def _symbol(spark, sf):
    return symbol_bars(load_bars(spark, sf), "S000007")


@query(
    "label_scan",
    oracle("select sample_id, ts_code, asof_date, label from samples", SAMPLES_SQL, dates="asof_date", ints="label"),
)
def _label_scan(spark, sf):
    path = scratch_path(spark, "labels")
    s = samples(spark, sf).select("sample_id", "ts_code", F.col("asof_date").alias("trade_date"), "label")
    s.write.mode("overwrite").option("header", True).csv(path)
    return sinks.read_labels(spark, path).select("sample_id", "ts_code", "asof_date", F.col("label").cast("int").alias("label"))


@query(
    "split_label_scan",
    oracle(
        """select sample_id, ts_code, asof_date, label, split from (select *, case when asof_date <= '1998-12-31' then 'train'
           when asof_date <= '2000-06-30' then 'valid' when ts_code like '%9' then 'other' else 'test' end as split from samples)
           where split in ('train', 'valid', 'test')""",
        SAMPLES_SQL, dates="asof_date", ints="label",
    ),
)
def _split_labels(spark, sf):
    d = F.col("asof_date")
    split = (
        F.when(d <= "1998-12-31", " Train").when(d <= "2000-06-30", "VALID ")
        .when(F.col("ts_code").endswith("9"), "other").otherwise("test")
    )
    raw = samples(spark, sf).withColumns({"split": split, "ts_code": F.lower("ts_code"), "asof_date": d.cast("string")})
    return sinks.split_labels(raw).select("sample_id", "ts_code", "asof_date", "label", "split")


@query(
    "training_bars",
    oracle(
        """select ts_code, trade_date, open, high, low, close, vol from (select *, row_number() over (partition by ts_code, trade_date
           order by ord desc) as rn from (select upper(symbol) as ts_code, trade_date, open, high, low, close, volume as vol, ord from dirty
           where close is not null and close > 0)) where rn = 1""",
        DIRTY_SQL, dates="trade_date", nums="open high low close vol",
    ),
)
def _training(spark, sf):
    return nz.training_bars(dirty(spark, sf).withColumnRenamed("symbol", "ts_code"), "ord")


@query(
    "market_store",
    oracle("select symbol, count(*) as n, sum(volume) as volume from dirty group by symbol", DIRTY_SQL, nums="volume", ints="n"),
)
def _store(spark, sf):
    store = sinks.MarketStore(spark, scratch_path(spark, "store"))
    store.save_daily_prices(dirty(spark, sf), "US")
    return store.load_daily_prices("US").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query(
    "us_export_by_symbol",
    oracle(
        """select upper(symbol) as ts_code, upper(symbol) as symbol, 'US' as market, trade_date, open, high, low, close, volume as vol, volume, adj_close
           from dirty where symbol in (select symbol from dirty group by symbol having count(*) >= 550)""",
        DIRTY_SQL, dates="trade_date", nums="open high low close vol volume adj_close",
    ),
)
def _us_export(spark, sf):
    return sinks.us_by_symbol(dirty(spark, sf).withColumn("symbol", F.lower("symbol")), 550)


@query(
    "us_export_summary",
    oracle(
        """select sum(n) as input_rows, count(*) as input_symbols, count(*) filter (where n >= 550) as exported_symbols,
           count(*) filter (where n < 550) as skipped_symbols from (select symbol, count(*) as n from dirty group by symbol)""",
        DIRTY_SQL, ints="input_rows input_symbols exported_symbols skipped_symbols",
    ),
)
def _us_summary(spark, sf):
    return sinks.us_export_summary(dirty(spark, sf), 550)


@query(
    "cn_export_by_symbol",
    oracle(
        "select ts_code, trade_date, open, high, low, close, vol, amount from bars",
        dates="trade_date", nums="open high low close vol amount",
    ),
)
def _cn_export(spark, sf):
    path = scratch_path(spark, "cn")
    flat = load_bars(spark, sf).withColumn("trade_date", F.date_format("trade_date", "yyyyMMdd"))
    sinks.export_cn_by_symbol(flat, F.lit(0), path)
    return spark.read.parquet(path)


@query(
    "increment_split",
    oracle("select ts_code, trade_date, open, high, low, close, vol, amount from increment", INCREMENT_SQL,
           dates="trade_date", nums="open high low close vol amount"),
)
def _increment_split(spark, sf):
    return nz.increment_rows(increment(spark, sf).withColumn("name", F.lit("x")), F.lit(0))


@query(
    "increment_sink",
    oracle("select ts_code, count(*) as n, sum(vol) as vol from increment group by ts_code", INCREMENT_SQL, nums="vol", ints="n"),
)
def _increment_sink(spark, sf):
    path = scratch_path(spark, "inc")
    sinks.save_increment(increment(spark, sf), path)
    return spark.read.parquet(path).groupBy("ts_code").agg(F.count(F.lit(1)).alias("n"), F.sum("vol").alias("vol"))


@query(
    "failed_dates",
    oracle("select trade_date, n from (select trade_date, count(*) as n from bars group by trade_date) where n < 20", dates="trade_date", ints="n"),
)
def _failed(spark, sf):
    """Dates with few bars, written as a date to list map and read back."""
    path = scratch_path(spark, "failed")
    b = load_bars(spark, sf).select(F.col("trade_date").cast("string").alias("trade_date"), "ts_code")
    # counted first: only the codes of dates with few of them are listed
    few = b.groupBy("trade_date").agg(F.count_distinct("ts_code").alias("n")).where("n < 20").select("trade_date")
    sinks.save_failed_dates(b.join(few, "trade_date").groupBy("trade_date").agg(F.collect_set("ts_code").alias("endpoints")), path)
    return sinks.load_failed_dates(spark, path).select("trade_date", F.size("endpoints").alias("n"))


def payloads(spark, sf):
    """One chart payload per symbol and year: parallel arrays plus dividend and split events."""
    b = load_bars(spark, sf).withColumns({"sec": F.unix_timestamp(F.col("trade_date").cast("timestamp")), "d": F.dayofmonth("trade_date")})
    row = F.struct("sec", "open", "high", "low", "close", "vol", "d")
    g = b.groupBy(F.lower("ts_code").alias("symbol"), F.year("trade_date").alias("y")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    field = lambda f: F.transform("r", lambda x: x[f])
    event = lambda day, make: F.map_from_entries(
        F.transform(F.filter("r", lambda x: x["d"] == day), lambda x: F.struct(x["sec"].cast("string"), make(x)))
    )
    div = event(15, lambda x: F.struct(x["sec"].alias("date"), (x["close"] * 0.01).alias("amount")))
    spl = event(28, lambda x: F.struct(x["sec"].alias("date"), F.lit(2.0).alias("numerator"), F.lit(0.0).alias("denominator"), F.lit("3:2").alias("splitRatio")))
    quote = F.struct(field("open").alias("open"), field("high").alias("high"), field("low").alias("low"), field("close").alias("close"),
                     F.slice(field("vol"), F.lit(1), F.size("r") - 1).alias("volume"))
    result = F.struct(
        field("sec").alias("timestamp"),
        F.struct(F.array(quote).alias("quote"), F.array(F.struct(field("close").alias("adjclose"))).alias("adjclose")).alias("indicators"),
        F.struct(div.alias("dividends"), spl.alias("splits")).alias("events"),
    )
    return g.where(F.size("r") > 1).select("symbol", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("payload"))


CHART_SQL = """paid as (select *, count(*) over (partition by ts_code, year(trade_date)) as n,
  row_number() over (partition by ts_code, year(trade_date) order by trade_date desc) as back from bars)"""


@query(
    "chart_prices",
    oracle(
        """select concat('US:', ts_code) as instrument_id, ts_code as symbol, 'US' as market, trade_date, open, high, low, close,
           case when back > 1 then vol end as volume, close as adj_close, case when day(trade_date) = 15 then close * 0.01::double end as dividends,
           case when day(trade_date) = 28 then 1.5 end as stock_splits, 'chart' as source from paid where n > 1""",
        CHART_SQL, dates="trade_date", nums="open high low close volume adj_close dividends stock_splits",
    ),
)
def _chart(spark, sf):
    return chart.daily_prices(payloads(spark, sf))


@query(
    "chart_actions",
    oracle(
        """select concat('US:', ts_code) as instrument_id, ts_code as symbol, 'US' as market, trade_date as action_date,
           case when day(trade_date) = 15 then 'dividend' else 'stock_split' end as action_type,
           case when day(trade_date) = 15 then close * 0.01::double else 1.5 end as value, 'chart' as source
           from paid where n > 1 and day(trade_date) in (15, 28)""",
        CHART_SQL, dates="action_date", nums="value",
    ),
)
def _actions(spark, sf):
    return chart.corporate_actions(payloads(spark, sf))


@query(
    "corporate_action_table",
    oracle(
        """select ts_code as symbol, trade_date as action_date, 'dividend' as action_type, close * 0.01::double as value
           from paid where n > 1 and day(trade_date) = 15 and trade_date between '1996-01-01' and '1999-12-31'
           union all select ts_code, trade_date, 'stock_split', 1.5 from paid where n > 1 and day(trade_date) = 28
           and trade_date between '1996-01-01' and '1999-12-31'""",
        CHART_SQL, dates="action_date", nums="value",
    ),
)
def _action_table(spark, sf):
    acts = chart.corporate_actions(payloads(spark, sf))
    return chart.action_table(acts, "1996-01-01", "1999-12-31").select("symbol", "action_date", "action_type", "value")


@query(
    "instrument_table",
    oracle(
        """select concat('US:', upper(symbol)) as instrument_id, upper(symbol) as symbol, 'US' as market, exchange, name,
           'equity' as asset_type, sector, cast(null as varchar) as industry, 'USD' as currency, true as is_active,
           cast(null as varchar) as list_date, cast(null as varchar) as delist_date, 'universe' as source from universe""",
        UNIVERSE_SQL, bars=False,
    ),
)
def _instruments(spark, sf):
    return nz.instruments(universe_rows(spark, sf)).drop("updated_at")


@query(
    "folder_audit",
    oracle(
        "select ts_code, count(*) as rows, min(trade_date) as date_min, max(trade_date) as date_max, true as ok, '' as missing_columns from bars group by ts_code",
        dates="date_min date_max", ints="rows",
    ),
)
def _audit(spark, sf):
    df = read_by_entity(spark, _entity_folder(spark, sf), allow_full_scan=True)
    # a symbol folder can hold several files; audit per symbol
    return qa.folder_audit(df.withColumn("entity_file", F.col("ts_code"))).drop("entity_file")


@query(
    "folder_audit_summary",
    oracle(
        """select count(*) as files, count(*) as files_ok, sum(n) as total_rows, min(n) as min_rows, max(n) as max_rows,
           count(distinct ts_code) as symbols, min(a) as date_min, max(b) as date_max
           from (select ts_code, count(*) as n, min(trade_date) as a, max(trade_date) as b from bars group by ts_code)""",
        dates="date_min date_max", ints="files files_ok total_rows min_rows max_rows symbols",
    ),
)
def _audit_summary(spark, sf):
    df = load_bars(spark, sf).withColumn("entity_file", F.col("ts_code"))
    return qa.folder_summary(qa.folder_audit(df))


@query(
    "ranked_csv_sink",
    oracle("select anchor_date as asof_date, count(*) as n, max(phase1_score_mean) as best from hits group by anchor_date", HITS_SQL,
           dates="asof_date", nums="best", ints="n"),
)
def _ranked_csv(spark, sf):
    path = scratch_path(spark, "ranked")
    ranked = hits(spark, sf).select("ts_code", F.col("phase1_score_mean").alias("score"), F.col("anchor_date").alias("asof_date"))
    sinks.write_ranked_csv(ranked.repartition("asof_date"), path)
    back = spark.read.option("header", True).schema("ts_code string, score double, asof_date date").csv(path)
    return back.groupBy("asof_date").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


@query(
    "predictions_asof",
    oracle("select sample_id, ts_code, asof_date, score from pred_a where asof_date = (select max(asof_date) from pred_a where ts_code = 'S000003')",
           PREDS_SQL, dates="asof_date", nums="score"),
)
def _predictions(spark, sf):
    p = pred(spark, sf, 7.13)
    last = str(p.where("ts_code = 'S000003'").agg(F.max("asof_date")).first()[0])
    return sinks.predictions_on(p, last).select("sample_id", "ts_code", "asof_date", "score")


@query(
    "code_matrix",
    oracle(
        """select r.rank, coalesce(max(case when k = 1 then ts_code end), '') as d1, coalesce(max(case when k = 2 then ts_code end), '') as d2,
           coalesce(max(case when k = 3 then ts_code end), '') as d3 from range(1, 13) r(rank) left join (
           select h.ts_code, h.phase1_rank, d.k from hits h join (select date, row_number() over (order by date desc) as k from
             (select distinct anchor_date as date from hits)) d on h.anchor_date = d.date) x on x.phase1_rank = r.rank group by r.rank""",
        HITS_SQL, ints="rank",
    ),
)
def _matrix(spark, sf):
    h = hits(spark, sf).withColumns({"target_date": F.col("anchor_date").cast("string"), "final_rank": F.col("phase1_rank")})
    dates = [r[0] for r in h.select("target_date").distinct().orderBy(F.desc("target_date")).limit(3).collect()]
    m = sinks.code_matrix(h, 12, dates)
    return m.select("rank", *[F.col(d).alias(f"d{i + 1}") for i, d in enumerate(dates)])


@query(
    "code_inference",
    oracle(
        """select case when day(trade_date) % 3 = 0 then ts_code when day(trade_date) % 3 = 1 then concat('sym_', ts_code)
           else concat('file_', ts_code) end as code, count(*) as n from bars group by 1""",
        ints="n",
    ),
)
def _code(spark, sf):
    d = F.dayofmonth("trade_date") % 3
    b = load_bars(spark, sf).withColumn("entity_file", F.concat(F.lit("file_"), "ts_code"))
    b = b.withColumns({"symbol": F.when(d < 2, F.concat(F.lit("sym_"), "ts_code")), "ts_code": F.when(d == 0, F.col("ts_code"))})
    return b.select(nz.infer_code(b).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "daily_units",
    oracle(
        """select ts_code, trade_date, open, high, low, close, vol * 100 as vol, amount * 1000 as amount, lag(close) over w as pre_close,
           close - lag(close) over w as change, (close - lag(close) over w) / lag(close) over w * 100 as pct_chg_calc
           from bars window w as (partition by ts_code order by trade_date)""",
        dates="trade_date", nums="open high low close vol amount pre_close change pct_chg_calc",
    ),
)
def _units(spark, sf):
    return nz.daily_with_units(load_bars(spark, sf), duplicates="raise", derive=True)


@query(
    "daily_units_keep_first",
    oracle(
        "select symbol as ts_code, trade_date, volume * 100 as vol from dirty where ord % 2 = 0",
        DIRTY_SQL, dates="trade_date", nums="vol",
    ),
)
def _units_first(spark, sf):
    d = dirty(spark, sf).withColumnsRenamed({"symbol": "ts_code", "volume": "vol"})
    return nz.daily_with_units(d, "ord", duplicates="first").select("ts_code", "trade_date", "vol")


@query(
    "cn_flat",
    oracle(
        """select symbol as ts_code, trade_date, close, volume as vol from (select *, row_number() over
           (partition by symbol, trade_date order by ord desc) as k from dirty) where k = 1""",
        DIRTY_SQL, dates="trade_date", nums="close vol",
    ),
)
def _cn_flat(spark, sf):
    d = dirty(spark, sf).select(
        F.concat(F.lit(" "), "symbol", F.lit(" ")).alias("ts_code"), F.col("trade_date").cast("string").alias("trade_date"),
        F.col("close").cast("string").alias("close"), F.col("volume").alias("vol"), F.col("ord").alias("__ord"),
    )
    return nz.cn_flat(d, "__ord").select("ts_code", "trade_date", "close", "vol")


@query("cn_symbol", oracle("select ts_code, trade_date, close, vol from bars where ts_code <> 'S000004'", dates="trade_date", nums="close vol"))
def _cn_symbol(spark, sf):
    bad = F.when(F.col("ts_code") == "S000004", F.lit("not a date")).otherwise(F.col("trade_date").cast("string"))
    b = load_bars(spark, sf).select("ts_code", bad.alias("trade_date"), F.col("close").cast("string").alias("close"), "vol")
    return nz.cn_symbol(b)


@query(
    "us_price_projection",
    oracle(
        """select cast(null as varchar) as instrument_id, symbol, cast(null as varchar) as market, trade_date, open, high, low, close, volume, adj_close,
           cast(null as double) as dividends, cast(null as double) as stock_splits, cast(null as varchar) as source from dirty""",
        DIRTY_SQL, dates="trade_date", nums="open high low close volume adj_close dividends stock_splits",
    ),
)
def _us_prices(spark, sf):
    return nz.us_prices(dirty(spark, sf)).drop("created_at")


@query(
    "key_functions",
    oracle(
        """select concat(upper('us'), ':', upper(lower(ts_code))) as instrument_id, concat(ts_code, '_', cast(trade_date as varchar)) as sample_id,
           strftime(trade_date, '%Y%m%d') as compact, case when day(trade_date) = 1 then '' else cast(trade_date as varchar) end as date_text from bars""",
    ),
)
def _keys(spark, sf):
    b = load_bars(spark, sf)
    text = F.when(F.dayofmonth("trade_date") == 1, F.lit("bad")).otherwise(F.date_format("trade_date", "yyyyMMdd"))
    return b.select(
        instrument_id(F.lit("us"), F.lower("ts_code")).alias("instrument_id"),
        sample_id("ts_code", "trade_date").alias("sample_id"),
        compact_date(F.col("trade_date")).alias("compact"),
        date_text(lenient_date(text)).alias("date_text"),
    )


@query(
    "schema_completion",
    oracle(
        """select sample_id, ts_code, asof_date, label, cast(null as varchar) as label_source, cast(null as double) as confidence,
           cast(null as varchar) as event_id, cast(null as varchar) as miner_name, cast(null as double) as candidate_score, close,
           cast(null as double) as ret_1d, cast(null as double) as ret_3d, cast(null as double) as vol_ratio_1d, cast(null as double) as vol_ratio_3d,
           cast(null as bigint) as base_window_days, cast(null as double) as base_range_pct, cast(null as boolean) as breakout_flag,
           cast(null as varchar) as rule_flags from samples""",
        SAMPLES_SQL, dates="asof_date", nums="close confidence candidate_score ret_1d ret_3d vol_ratio_1d vol_ratio_3d base_range_pct", ints="label",
    ),
)
def _complete(spark, sf):
    return mn.complete_schema(samples(spark, sf))


@query(
    "safe_names",
    oracle(
        """select name, case when length(s) > 0 then s else 'UNKNOWN' end as safe from (select name,
           regexp_replace(regexp_replace(trim(name), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') as s from (
           select concat('.', p_name, ' #', cast(p_partkey % 7 as varchar), '!') as name from part union all select '??' from part where p_partkey = 1))""",
        bars=False,
    ),
)
def _safe(spark, sf):
    p = read_parquet(spark, f"{sf}/part.parquet")
    names = p.select(F.concat(F.lit("."), "p_name", F.lit(" #"), (F.col("p_partkey") % 7).cast("string"), F.lit("!")).alias("name"))
    names = names.unionByName(p.where("p_partkey = 1").select(F.lit("??").alias("name")))
    return names.select("name", safe_name("name").alias("safe"))


@query(
    "split_ratios",
    oracle(
        """select ts_code, trade_date, case when d = 0 then 0.0 when d = 1 then 0.5 when d = 2 then 4.0 / 3 else 0.0 end as split_ratio
           from (select *, day(trade_date) % 4 as d from bars)""",
        dates="trade_date", nums="split_ratio",
    ),
)
def _splits(spark, sf):
    d = F.dayofmonth("trade_date") % 4
    num = F.when(d == 1, F.lit(1.0))
    den = F.when(d == 1, F.lit(2.0)).when(d == 2, F.lit(0.0))
    text = F.when(d == 2, "4:3").when(d == 3, "none")
    return load_bars(spark, sf).select("ts_code", "trade_date", split_ratio(num, den, text).alias("split_ratio"))


@query(
    "epoch_dates",
    oracle("select event_id, cast(ts as date) as utc_date from events", dates="utc_date", ints="event_id", bars=False),
)
def _epoch(spark, sf):
    e = read_parquet(spark, f"{sf}/events.parquet", ["event_id", "ts"])
    return e.select("event_id", chart.utc_date(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("utc_date"))


@query(
    "limit_up_days",
    oracle(
        """select ts_code, trade_date, (pct >= case when code like '300%' or code like '688%' then 19 else 9.5 end) as limit_like from (
           select ts_code, trade_date, (close / open - 1) * 100 as pct, case when ts_code like '%3' then concat('300', ts_code) else ts_code end as code from bars)""",
        dates="trade_date",
    ),
)
def _limit(spark, sf):
    b = load_bars(spark, sf).withColumns({
        "pct": (F.col("close") / F.col("open") - 1) * 100,
        "code": F.when(F.col("ts_code").endswith("3"), F.concat(F.lit("300"), "ts_code")).otherwise(F.col("ts_code")),
    })
    return b.select("ts_code", "trade_date", limit_like("code", "pct").alias("limit_like"))


@query(
    "union_frames",
    oracle(
        """select ts_code, trade_date, close, cast(null as double) as score from bars union all
           select ts_code, asof_date, cast(null as double), score from pred_a""",
        PREDS_SQL, dates="trade_date", nums="close score",
    ),
)
def _union(spark, sf):
    b = load_bars(spark, sf).select("ts_code", "trade_date", "close")
    p = pred(spark, sf, 7.13).select("ts_code", F.col("asof_date").alias("trade_date"), "score")
    return b.unionByName(p, allowMissingColumns=True)


@query(
    "keep_last",
    oracle(
        """select ts_code, trade_date, close, vol from (select *, row_number() over (partition by ts_code, trade_date order by late desc) as k from (
             select ts_code, trade_date, close, vol, 1 as late from increment union all select ts_code, trade_date, close, vol, 0 from bars)) where k = 1""",
        INCREMENT_SQL, dates="trade_date", nums="close vol",
    ),
)
def _keep_last(spark, sf):
    return merge_flat([load_bars(spark, sf), increment(spark, sf)]).select("ts_code", "trade_date", "close", "vol")


@query(
    "upsert_increment",
    oracle(
        """select ts_code, trade_date, open, high, low, close, vol, amount from (select *, row_number() over (partition by ts_code, trade_date order by late desc) as k from (
             select ts_code, trade_date, open, high, low, close, vol, amount, 1 as late from increment union all
             select ts_code, trade_date, open, high, low, close, vol, amount, 0 from bars)) where k = 1""",
        INCREMENT_SQL, dates="trade_date", nums="open high low close vol amount",
    ),
)
def _upsert(spark, sf):
    return upsert(load_bars(spark, sf), increment(spark, sf), nz.CN_COLUMNS)


@query(
    "upsert_summary",
    oracle(
        """select (select count(distinct ts_code) from bars) as base_symbols, (select count(distinct ts_code) from increment) as increment_symbols,
           count(distinct ts_code) as output_symbols, count(*) as output_rows from (select ts_code, trade_date from bars union select ts_code, trade_date from increment)""",
        INCREMENT_SQL, ints="base_symbols increment_symbols output_symbols output_rows",
    ),
)
def _upsert_summary(spark, sf):
    b, i = load_bars(spark, sf), increment(spark, sf)
    return upsert_summary(b, i, upsert(b, i))


@query(
    "bar_order_index",
    oracle("select ts_code, trade_date, row_number() over (partition by ts_code order by trade_date) as rn from bars", dates="trade_date", ints="rn"),
)
def _index(spark, sf):
    return load_bars(spark, sf).select("ts_code", "trade_date", BARS.index().alias("rn"))
