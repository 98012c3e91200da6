"""URL filters as a sort-merge range join, with DataFrame functions only.

A host is keyed by its labels in reverse (``m.a.net`` -> ``net.a.m.``), so a host and all its
subdomains are one interval of keys; the rules of one host are intervals of paths in the same
way. Points (urls) and interval ends (rules) are sorted together and swept. Prefix intervals
are disjoint or nested, so the active rules are a stack: its depth is the running sum of starts
minus ends, and the entry at level k is the last start that had level k. Two windows per sweep
express that without state outside Spark: the depth, then the last start by level.

Work is dealt into ``slots``. A zone is the last two labels of a host; a zone with more than
1/slots of the urls is split into as many pieces as its share asks for, each piece with its own
copy of that zone's rules. Rules of less than two labels go to every slot. So a host that holds
a third of all urls is spread over a third of the slots, and both sweeps, the choice of the
longest rule and the result need one shuffle of (id, host, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"


def _after(key: Column) -> Column:
    """A key above all that start with ``key``: no byte of UTF-8 is FF."""
    return F.concat(key, F.unhex(F.lit("FF")))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    labels = F.reverse(F.split(host, r"\."))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))


def _zone(key: Column) -> Column:
    """The first two labels of a reversed host; null for fewer."""
    found = F.regexp_extract(key, r"(?s)^([^.]*\.[^.]*\.)", 1)
    return F.when(found != "", found)


def parse_rules(df: DataFrame, rule_col: str = "rule", verdict_col: str = "verdict") -> DataFrame:
    """``host/path`` strings as (rule, verdict, host, path); a null, empty or repeated rule counts once or not at all.

    Of the same rule with both verdicts, block wins.
    """
    rules = df.where(F.col(rule_col).isNotNull() & (F.col(rule_col) != "")).groupBy(F.col(rule_col).alias("rule")).agg(F.max(F.col(verdict_col)).alias("verdict"))
    slash = F.locate("/", F.col("rule"))
    host = F.when(slash > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule"))
    path = F.when(slash > 0, F.expr("substring(rule, locate('/', rule))")).otherwise(F.lit(""))
    return rules.select("rule", "verdict", F.lower(host).alias("host"), path.alias("path"))


def filter_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW, slots: int = 1024) -> DataFrame:
    """Verdict of the longest fitting rule for every url; one row per input row.

    ``rules`` has the columns rule, verdict, host, path of ``parse_rules``. Columns of the
    result: the id, host, path, rule (null if none fits) and verdict (``default`` if none fits).
    Null and malformed urls have an empty host and path. Repeated rows, ids without a value and
    urls that are null each give their row. Equally long rules: the larger string wins. No rules
    or no urls are fine. Other columns of ``df`` aren't read, whatever their names.
    """
    urls = df.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    urls = urls.withColumn("hkey", _reversed(F.col("host"))).withColumn("zone", _zone(F.col("hkey")))

    # Zones above 1/slots of all urls: less than ``slots`` rows, whatever the input.
    zones = urls.groupBy("zone").agg(F.count("*").alias("n"))
    total = zones.agg(F.sum("n").alias("total"))
    hot = zones.where(F.col("n") * slots > total.scalar()).select(F.col("zone").alias("hot_zone"), F.ceil(F.col("n") * slots / total.scalar()).cast("int").alias("pieces"))
    in_zone = lambda zone, piece: F.pmod(F.xxhash64(zone, piece), F.lit(slots)).cast("int")
    pieces = F.coalesce("pieces", F.lit(1))

    points = (
        urls.join(F.broadcast(hot), F.col("zone").eqNullSafe(F.col("hot_zone")), "left")
        .withColumn("piece", F.pmod(F.xxhash64("id", "host", "path"), pieces).cast("int"))
        .select(in_zone(F.col("zone"), F.col("piece")).alias("slot"), "id", "host", "path", F.encode("hkey", "UTF-8").alias("at"))
    )

    # Rule events: starts and ends of host intervals, and the path rules that pass the first sweep untouched.
    ruled = rules.select("rule", "verdict", "path", _reversed(F.col("host")).alias("rhost")).withColumn("zone", _zone(F.col("rhost")))
    placed = ruled.where("zone is not null").join(F.broadcast(hot), F.col("zone") == F.col("hot_zone"), "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).select("*", in_zone(F.col("zone"), F.col("piece")).alias("slot"))
    wide = ruled.where("zone is null").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    placed = placed.select("slot", "rule", "verdict", "path", "rhost").unionByName(wide.select("slot", "rule", "verdict", "path", "rhost")).distinct()
    key = F.encode("rhost", "UTF-8")
    hosts = placed.select("slot", "rhost").distinct()
    ends = hosts.select("slot", "rhost", F.explode(F.array(F.struct(F.lit(0).alias("kind"), key.alias("at"), F.lit(1).alias("step")), F.struct(F.lit(2).alias("kind"), _after(key).alias("at"), F.lit(-1).alias("step")))).alias("e")).select("slot", "rhost", "e.*")
    own = placed.select("slot", "rhost", "rule", "verdict", "path", F.lit(3).alias("kind"), key.alias("at"), F.lit(0).alias("step"))
    events = points.withColumns({"kind": F.lit(1), "step": F.lit(0)}).unionByName(ends, allowMissingColumns=True).unionByName(own, allowMissingColumns=True)

    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.sum("step").over(upto(Window.partitionBy("slot").orderBy("at", "kind")))
    # A url gets one row for each active level; a start keeps its own level; ends are done with.
    swept = events.withColumn("depth", depth.cast("int")).where("kind <> 2")
    own_level = F.when(F.col("kind") == 0, F.col("depth")).otherwise(F.lit(-1))
    levels = swept.withColumn("level", F.explode(F.when(F.col("kind") == 1, F.sequence(F.lit(0), F.col("depth"))).otherwise(F.array(own_level))))
    active = F.last(F.when(F.col("kind") == 0, F.col("rhost")), ignorenulls=True).over(upto(Window.partitionBy("slot", "level").orderBy("at", "kind")))
    # Level 0 stands for the url itself, so that one without a fitting rule keeps its row.
    hosted = levels.withColumn("holder", F.when(F.col("kind") == 3, F.col("rhost")).when((F.col("kind") == 1) & (F.col("level") > 0), active)).where("kind <> 0")

    # Second sweep, over the paths below each active host.
    path_key = F.encode("path", "UTF-8")
    moves = F.when(F.col("kind") == 3, F.array(F.struct(F.lit(0).alias("turn"), path_key.alias("pat"), F.lit(1).alias("move")), F.struct(F.lit(2).alias("turn"), _after(path_key).alias("pat"), F.lit(-1).alias("move")))).otherwise(F.array(F.struct(F.lit(1).alias("turn"), path_key.alias("pat"), F.lit(0).alias("move"))))
    paths = hosted.select("slot", "holder", "id", "host", "path", "level", "rule", "verdict", F.explode(moves).alias("m")).select("*", "m.turn", "m.pat", "m.move").drop("m")
    pdepth = F.sum("move").over(upto(Window.partitionBy("slot", "holder").orderBy("pat", "turn")))
    nested = paths.withColumn("pdepth", pdepth).where("turn <> 2")
    top = F.last(F.when(F.col("turn") == 0, F.struct(F.length("rule").alias("size"), "rule", "verdict")), ignorenulls=True).over(upto(Window.partitionBy("slot", "holder", "pdepth").orderBy("pat", "turn")))
    judged = nested.withColumn("top", F.when(F.col("holder").isNotNull() & (F.col("pdepth") > 0), top)).where("turn = 1")

    best = judged.groupBy("slot", "id", "host", "path").agg(F.max("top").alias("best"), F.sum((F.col("level") == 0).cast("int")).alias("copies"))
    return best.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
