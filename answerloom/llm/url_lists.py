"""URL block lists with dated entries, applied to captures as of their fetch time."""

from pyspark.sql import Window, functions as F

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::[0-9]*)?([^?#]*)"


def url_keys(url):
    """All list keys a URL falls under: its host, the host's parents, host and leading path segments.

    NULL where there is no host.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"\.+$", "")
    labels = F.split(host, r"\.")
    parents = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    segments = F.array_remove(F.split(F.regexp_extract(url, URL, 2), "/"), "")
    paths = F.transform(segments, lambda _, i: F.concat_ws("/", host, F.array_join(F.slice(segments, F.lit(1), i + 1), "/")))
    return F.when(host != "", F.array_distinct(F.concat(parents, paths)))


def validity_intervals(events):
    """``(list, key, valid_from, valid_to)`` from dated ``(list, key, day, action)`` events.

    ``add`` opens an entry until the key's next ``remove`` on that list (valid_to NULL: still open);
    on one day an add wins over a remove. Rows with NULLs are left out. Days of a key are
    reduced by an aggregate first, so a key's window holds at most one row a day.
    """
    known = events.select("list", "key", "day", (F.col("action") == "add").alias("on")).dropna()
    days = known.groupBy("list", "key", "day").agg(F.max("on").alias("on"))
    of_key = Window.partitionBy("list", "key").orderBy("day")
    # Only changes of state begin or end an interval.
    changes = days.withColumn("before", F.lag("on").over(of_key)).where("on <> coalesce(before, false)")
    spans = changes.withColumn("valid_to", F.lead("day").over(of_key)).where("on")
    return spans.select("list", "key", F.col("day").alias("valid_from"), "valid_to")


def blocked_captures(captures, events, url_col="url", day_col="day"):
    """``captures`` with ``blocked``, ``n_entries`` and ``entry``, the longest matching key (ties: first).

    A capture is blocked if an entry for any of its keys (see ``url_keys``) is
    active on its fetch day: valid_from <= day < valid_to. Intervals are dealt
    out to the months they cover, up to the last fetch day, and meet captures on (key, month); so a
    capture meets only the few intervals near its day, and a hot key is spread over months and may
    be split by Spark. Each (url, day) is evaluated once. Captures without a URL or day, and
    URLs without a host, are not blocked. Repeated captures stay repeated;
    columns of the three result names are replaced.
    """
    new = ["blocked", "n_entries", "entry"]
    captures = captures.drop(*new)
    month = lambda c: F.trunc(c, "month")
    asked = captures.select(F.col(url_col).alias("u"), F.col(day_col).alias("d")).dropna().distinct()
    keys = asked.withColumn("key", F.explode(url_keys(F.col("u")))).withColumn("m", month("d"))
    last = captures.agg(F.max(day_col).alias("last")).first()["last"]
    intervals = validity_intervals(events).where(F.col("valid_from") <= F.lit(last))
    end = F.least(F.date_sub(F.coalesce("valid_to", F.date_add(F.lit(last), 1)), 1), F.lit(last).cast("date"))
    monthly = intervals.withColumn("m", F.explode(F.sequence(month("valid_from"), month(end), F.expr("interval 1 month"))))
    hits = (
        keys.join(monthly, ["key", "m"])
        .where((F.col("valid_from") <= F.col("d")) & (F.col("valid_to").isNull() | (F.col("d") < F.col("valid_to"))))
        .groupBy("u", "d").agg(
            F.count("*").alias("n_entries"),
            F.min(F.struct((-F.char_length("key")).alias("n"), "key")).alias("best"))
        .select("u", "d", "n_entries", F.col("best.key").alias("entry"))
    )
    joined = captures.join(hits, (F.col(url_col) == F.col("u")) & (F.col(day_col) == F.col("d")), "left")
    return joined.withColumn("blocked", F.col("n_entries").isNotNull()).withColumn(
        "n_entries", F.coalesce("n_entries", F.lit(0))).select(*captures.columns, *new)
