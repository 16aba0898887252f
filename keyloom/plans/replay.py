"""Replay of an ordered command log into a keyspace.

Keys are first grouped: keys that one command touches together belong to one group. A group whose
commands are all of one algebraic kind (last write, sums, membership, pushes) is folded by DataFrame
aggregations, in which a DEL or SET is a barrier that nothing before it survives. Every other group
is replayed in the order of ``seq`` by the model of single commands, group by group; only that path holds
a group's log in one task. Replay reads the log and never appends to it. A failing command has no effect.

Of a keyspace that a log is replayed onto, only the keys that the log touches are folded; the others are
carried over as they are. A key's time to live from there is a barrier too, once the log goes beyond it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import score_text
from ..operators.components import connected_components
from ..schema import Keyspace
from ..sources.staging import stage
from .model import MULTI_KEY, CommandError, Store

#: Commands of each algebraic kind, besides DEL of one key.
KINDS = {
    "strings": ("SET", "SETNX", "INCRBY", "INCR", "DECR", "DECRBY"),
    "hashes": ("HSET", "HDEL", "HINCRBY"),
    "sets": ("SADD", "SREM"),
    "zsets": ("ZADD", "ZINCRBY", "ZREM"),
    "lists": ("LPUSH", "RPUSH"),
}
TYPES = {"strings": "STRING", "hashes": "HASH", "sets": "SET", "zsets": "ZSET", "lists": "LIST"}
#: Values that one push may have and still be folded: positions leave room for so many.
MOST_PUSHED = 1_000_000
_ROWS = "key string, type string, expire_at bigint, sub string, pos bigint, value string, score double"
#: The keys that a command touches, as ``model.keys_of`` tells them.
KEYS = """CASE WHEN cmd = 'DEL' THEN concat(array(key), args) WHEN cmd = 'MSET' THEN filter(concat(array(key), args), (x, i) -> i % 2 = 0) WHEN cmd = 'BITOP' THEN args
  WHEN cmd IN ('SMOVE', 'RPOPLPUSH', 'BRPOPLPUSH') THEN concat(array(key), slice(args, 1, 1)) WHEN cmd IN ('BLPOP', 'BRPOP') THEN concat(array(key), slice(args, 1, greatest(size(args) - 1, 0)))
  WHEN cmd IN ('ZUNIONSTORE', 'ZINTERSTORE') THEN concat(array(key), slice(args, 2, greatest(coalesce(try_cast(get(args, 0) AS INT), 0), 0))) ELSE array(key) END"""


def group_keys(log: DataFrame) -> DataFrame | None:
    """(key, group) of keys that multi-key commands tie together, None without any; keys on their own are left out."""
    many = log.filter(F.col("cmd").isin(*MULTI_KEY) & (F.size("args") > 0)).select(F.array_distinct(F.expr(KEYS)).alias("keys")).filter(F.size("keys") > 1)
    links = many.select(F.col("keys")[0].alias("u"), F.explode("keys").alias("v")).filter("u != v").distinct()
    if links.isEmpty():
        return None
    return connected_components(links, stage).select(F.col("node").alias("key"), F.col("component").alias("group"))


def _classified(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with ``group``, and (group, kind, cmds) of the groups; kind is null where a group needs its order."""
    groups = group_keys(log)
    # A command stands with the first key it touches, which for BITOP is not its first argument.
    home = log.withColumn("home", F.coalesce(F.try_element_at(F.expr(KEYS), F.lit(1)), "key")) if groups is not None else log
    tied = log.withColumn("alone", F.lit(True)).withColumn("group", F.col("key"))
    if groups is not None:
        tied = home.join(groups.withColumnRenamed("key", "home"), "home", "left").withColumn("alone", F.col("group").isNull()).withColumn("group", F.coalesce("group", "home")).drop("home")
    kind = F.lit(None).cast("string")
    for name, cmds in KINDS.items():
        kind = F.when(F.col("cmd").isin(*cmds), name).otherwise(kind)
    n = F.size("args")
    plain = n == F.when(F.col("cmd").isin("SET", "SETNX", "INCRBY", "DECRBY"), 1).when(F.col("cmd").isin("INCR", "DECR", "DEL"), 0).when(F.col("cmd").isin("HINCRBY", "ZINCRBY"), 2).otherwise(n)
    pairs = ~F.col("cmd").isin("HSET", "ZADD") | ((n % 2 == 0) & (n > 0))
    numbers = F.when(F.col("cmd").isin("INCRBY", "DECRBY"), F.try_element_at("args", F.lit(1)).rlike(r"^-?[0-9]{1,9}\z")).when(F.col("cmd") == "HINCRBY", F.try_element_at("args", F.lit(2)).rlike(r"^-?[0-9]{1,9}\z"))
    numbers = numbers.when(F.col("cmd") == "ZINCRBY", F.try_element_at("args", F.lit(1)).rlike(r"^-?[0-9]+(\.[0-9]+)?\z")).when(F.col("cmd") == "ZADD", F.forall(F.filter("args", lambda x, i: i % 2 == 0), lambda x: x.rlike(r"^-?[0-9]+(\.[0-9]+)?\z"))).otherwise(True)
    few = ~F.col("cmd").isin("LPUSH", "RPUSH") | (n <= MOST_PUSHED)
    ending = (F.col("cmd") == "PEXPIREAT") & F.col("of_base")
    fine = F.col("alone") & plain & pairs & few & F.coalesce(numbers, F.lit(False)) & (kind.isNotNull() | (F.col("cmd") == "DEL") | ending)
    # SET values and HSET values that counters build upon must be numbers; the order decides otherwise.
    counts = F.col("cmd").isin("INCR", "INCRBY", "DECR", "DECRBY", "HINCRBY")
    texts = (F.col("cmd").isin("SET", "SETNX") & ~F.coalesce(F.try_element_at("args", F.lit(1)).rlike(r"^-?[0-9]{1,15}\z"), F.lit(False))) | (F.col("cmd") == "HSET")
    # A container that loses its last element loses its time to live with it: then the order decides too.
    takes = F.col("cmd").isin("HDEL", "SREM", "ZREM")
    told = tied.withColumn("k", kind).groupBy("group").agg(
        F.bool_and(fine).alias("fine"), F.count_distinct("k").alias("kinds"), F.max("k").alias("kind"), (F.bool_or(counts) & F.bool_or(texts)).alias("mixed"), (F.bool_or(ending) & F.bool_or(takes)).alias("ends"), F.collect_set("cmd").alias("cmds")
    )
    return tied.drop("alone"), told.select("group", F.when(F.col("fine") & (F.col("kinds") <= 1) & ~F.col("mixed") & ~F.col("ends"), F.coalesce("kind", F.lit("strings"))).alias("kind"), "cmds")


def _after(rows: DataFrame, with_base: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows of each key from its last barrier on, and (key, expire_at) of keys whose end from the base still holds; partial maxima before the shuffle."""
    last = [F.max(F.when(F.col("cmd").isin("SET", "DEL"), F.col("seq"))).alias("bar")]
    if with_base:
        ending = F.col("cmd") == "PEXPIREAT"
        last += [F.max(F.when(ending, F.try_element_at("args", F.lit(1)).try_cast("bigint"))).alias("end"), F.max(F.when(ending, F.col("seq"))).alias("end_seq"), F.max("at_ms").alias("last_ms")]
    found = rows.groupBy("key").agg(*last)
    after = F.col("bar").isNull() | (F.col("seq") > F.col("bar")) | ((F.col("seq") == F.col("bar")) & (F.col("cmd") != "DEL"))
    if not with_base:
        return rows.join(found, "key").filter(after), None
    past = F.coalesce(F.col("last_ms") > F.col("end"), F.lit(False))
    kept = rows.join(found, "key").filter(after & (~past | (F.col("at_ms") > F.col("end"))) & (F.col("cmd") != "PEXPIREAT"))
    holds = found.filter(F.col("end").isNotNull() & ~past & (F.col("bar").isNull() | (F.col("bar") < F.col("end_seq"))))
    return kept, holds.select("key", F.col("end").alias("expire_at"))


def _latest_then_sum(rows: DataFrame, by: list[str], zero) -> DataFrame:
    """Rows (by, seq, arg, op: put, add or drop, value) -> by, value: the last put or nothing, plus what was added since."""
    last = rows.filter("op != 'add'").groupBy(*by).agg(F.max(F.struct("seq", "arg", "op", "value")).alias("last"))
    joined = rows.join(last, by, "left")
    since = F.col("last").isNull() | (F.struct("seq", "arg") > F.struct("last.seq", "last.arg"))
    adds = F.sum(F.when((F.col("op") == "add") & since, F.col("value")))
    out = joined.groupBy(*by).agg(adds.alias("adds"), F.max(F.col("last")).alias("last"))
    put = F.col("last.op") == "put"
    return out.filter(F.coalesce(put, F.lit(False)) | F.col("adds").isNotNull()).select(*by, (F.when(put, F.col("last.value")).otherwise(zero) + F.coalesce("adds", zero)).alias("value"))


def _fold(log: DataFrame, kinds: set[str], with_base: bool, cmds: set[str]) -> DataFrame:
    """The algebraic groups of the ``kinds`` present, as rows of the fold's schema; ``cmds`` are the commands that occur."""
    a = lambda i: F.try_element_at("args", F.lit(i))
    none = {"sub": "string", "pos": "bigint", "value": "string", "score": "double"}

    def shaped(df: DataFrame, kind: str, ends: DataFrame | None) -> DataFrame:
        df = df.join(ends, "key", "left") if ends is not None else df.withColumn("expire_at", F.lit(None).cast("bigint"))
        cols = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()]
        return df.select("key", F.lit(TYPES[kind]).alias("type"), "expire_at", *cols)

    def paired(df: DataFrame, first: str, second: str) -> DataFrame:
        """(key, seq, arg, first, second) of argument pairs."""
        at = df.select("key", "seq", F.posexplode("args").alias("arg", first), "args").filter("arg % 2 = 0")
        return at.select("key", "seq", "arg", first, F.try_element_at("args", F.col("arg") + 2).alias(second))

    def singles(df: DataFrame, name: str, *more: str) -> DataFrame:
        return df.select("key", "seq", *more, F.posexplode("args").alias("arg", name))

    def strings(rows: DataFrame) -> DataFrame:
        # The last SET stands as it is if no counter follows it; without one the first command may be a SETNX.
        s = rows.filter("cmd != 'DEL'")
        delta = F.when(F.col("cmd") == "INCR", 1).when(F.col("cmd") == "DECR", -1).when(F.col("cmd") == "INCRBY", a(1).try_cast("bigint")).when(F.col("cmd") == "DECRBY", -a(1).try_cast("bigint"))
        first = F.min_by(F.struct("cmd", a(1).alias("value")), "seq").alias("first")
        base = s.groupBy("key").agg(F.max(F.when(F.col("cmd") == "SET", a(1))).alias("put"), F.sum(delta).alias("delta"), first)
        start = F.coalesce("put", F.when(F.col("first.cmd") == "SETNX", F.col("first.value")))
        return base.select("key", F.when(F.col("delta").isNull(), start).otherwise((F.coalesce(start.try_cast("bigint"), F.lit(0)) + F.col("delta")).cast("string")).alias("value"))

    def hashes(h: DataFrame) -> DataFrame:
        puts = paired(h.filter("cmd = 'HSET'"), "sub", "value").withColumn("op", F.lit("put"))
        drops = singles(h.filter("cmd = 'HDEL'"), "sub").withColumn("value", F.lit(None).cast("string")).withColumn("op", F.lit("drop"))
        last = puts.unionByName(drops).groupBy("key", "sub").agg(F.max_by(F.struct("op", "value"), F.struct("seq", "arg")).alias("x")).filter("x.op = 'put'").select("key", "sub", F.col("x.value").alias("value"))
        adds = h.filter("cmd = 'HINCRBY'").select("key", "seq", F.lit(0).alias("arg"), a(1).alias("sub"), a(2).try_cast("bigint").alias("value"), F.lit("add").alias("op"))
        counting = _latest_then_sum(adds.unionByName(drops.withColumn("value", F.lit(None).cast("bigint"))), ["key", "sub"], F.lit(0).cast("bigint")).withColumn("value", F.col("value").cast("string"))
        return last.unionByName(counting.join(last.select("key", "sub"), ["key", "sub"], "left_anti"))

    def sets(m: DataFrame) -> DataFrame:
        each = singles(m.filter("cmd != 'DEL'"), "value", "cmd")
        return each.groupBy("key", "value").agg(F.max_by("cmd", F.struct("seq", "arg")).alias("cmd")).filter("cmd = 'SADD'").drop("cmd")

    def zsets(z: DataFrame) -> DataFrame:
        put = paired(z.filter("cmd = 'ZADD'"), "value", "sub").select("key", "seq", "arg", "sub", F.col("value").try_cast("double").alias("value"), F.lit("put").alias("op"))
        drop = singles(z.filter("cmd = 'ZREM'"), "sub").select("key", "seq", "arg", "sub", F.lit(None).cast("double").alias("value"), F.lit("drop").alias("op"))
        add = z.filter("cmd = 'ZINCRBY'").select("key", "seq", F.lit(0).alias("arg"), a(2).alias("sub"), a(1).try_cast("double").alias("value"), F.lit("add").alias("op"))
        if not cmds & {"ZADD", "ZREM"}:
            return add.groupBy("key", "sub").agg(F.sum("value").alias("score"))
        return _latest_then_sum(put.unionByName(drop).unionByName(add), ["key", "sub"], F.lit(0.0)).withColumnRenamed("value", "score")

    def lists(rows: DataFrame) -> DataFrame:
        items = rows.filter("cmd != 'DEL'").select("key", "seq", "cmd", F.posexplode("args").alias("arg", "value"))
        # Positions order a list; a sequence number leaves room for a command's arguments, and those of a base,
        # which start at -2**41, still count up from zero.
        place = (F.col("seq") + F.lit(1 << 41)) * MOST_PUSHED + F.col("arg") + 1
        return items.select("key", F.when(F.col("cmd") == "LPUSH", -place).otherwise(place).alias("pos"), "value")

    out = log.sparkSession.createDataFrame([], _ROWS)
    for kind, fold in (("strings", strings), ("hashes", hashes), ("sets", sets), ("zsets", zsets), ("lists", lists)):
        if kind in kinds:
            rows, ends = log.filter(F.col("kind") == kind), None
            if with_base or cmds & {"SET", "DEL"}:  # else nothing bars what was before
                rows, ends = _after(rows, with_base)
            out = out.unionByName(shaped(fold(rows), kind, ends))
    return out


def _replayed(rows: pd.DataFrame) -> pd.DataFrame:
    """One group, command by command."""
    store, out = Store(), []
    for r in rows.sort_values("seq").itertuples():
        try:
            store.execute(r.cmd, r.key, *r.args, now_ms=int(r.at_ms))
        except CommandError:
            continue
    for key, (kind, data) in store.data.items():
        end = store.ends.get(key)
        if kind == "STRING":
            out.append((key, kind, end, None, None, data if isinstance(data, str) else data.decode("latin-1"), None))
        elif kind == "HASH":
            out += [(key, kind, end, f, None, v, None) for f, v in data.items()]
        elif kind == "LIST":
            out += [(key, kind, end, None, i, v, None) for i, v in enumerate(data)]
        elif kind == "SET":
            out += [(key, kind, end, None, None, m, None) for m in data]
        else:
            out += [(key, kind, end, m, None, None, s) for m, s in data.items()]
    got = pd.DataFrame(out, columns=["key", "type", "expire_at", "sub", "pos", "value", "score"])
    return got.astype({"expire_at": "Int64", "pos": "Int64", "score": "float64"})


def _commands(log: DataFrame) -> DataFrame:
    """``log`` as (seq, at_ms, cmd, key, args, of_base)."""
    at_ms = F.expr("datediff(cast(ts as date), date'1970-01-01') * 86400000L + (hour(ts) * 3600 + minute(ts) * 60) * 1000L + cast(extract(second from ts) * 1000 as bigint)")
    return log.select("seq", at_ms.alias("at_ms"), F.upper("cmd").alias("cmd"), "key", F.coalesce("args", F.array().cast("array<string>")).alias("args"), F.lit(False).alias("of_base"))


def unknown_commands(log: DataFrame) -> DataFrame:
    """(cmd, count) of commands that no replay knows, which therefore have no effect."""
    known = [name.removeprefix("do_").replace("bf_", "bf.").upper() for name in dir(Store) if name.startswith("do_")]
    return log.select(F.upper("cmd").alias("cmd")).filter(~F.col("cmd").isin(known)).groupBy("cmd").agg(F.count("*").alias("count"))


def _folded(rows: DataFrame, with_base: bool) -> Keyspace:
    """The keyspace that ``rows`` (of ``_commands``) make."""
    tied, told = _classified(rows)
    seen = told.agg(F.collect_set(F.coalesce("kind", F.lit(""))).alias("kinds"), F.array_distinct(F.flatten(F.collect_set("cmds"))).alias("cmds")).first()  # as many as there are commands
    kinds, cmds = set(seen["kinds"]), set(seen["cmds"])
    if len(kinds) == 1 and "" not in kinds:  # nothing is told apart: one fold over the log as it is
        return keyspace_of(_fold(tied.withColumn("kind", F.lit(next(iter(kinds)))), kinds, with_base, cmds))
    marked = stage(tied.join(told.drop("cmds"), "group"), "replay-log")
    folded = _fold(marked.filter(F.col("kind").isNotNull()), kinds - {""}, with_base, cmds)
    if "" in kinds:
        ordered = marked.filter(F.col("kind").isNull()).select("group", "seq", "at_ms", "cmd", "key", "args")
        folded = folded.unionByName(ordered.groupBy("group").applyInPandas(_replayed, _ROWS))
    return keyspace_of(stage(folded, "replay-rows"))


def replay_onto(log: DataFrame, base: Keyspace) -> tuple[DataFrame, Keyspace]:
    """The keys (key) that ``log`` touches, and what they hold once it is replayed onto ``base``; nothing else is read into the fold."""
    rows = _commands(log)
    touched = stage(rows.select(F.explode(F.expr(KEYS)).alias("key")).distinct(), "replay-touched")
    own = Keyspace(**{name: rel.join(touched, "key", "left_semi") for name, rel in base.relations().items()})
    before = as_commands(own).select("seq", F.lit(0).cast("bigint").alias("at_ms"), "cmd", "key", "args", F.lit(True).alias("of_base"))
    return touched, _folded(rows.unionByName(before), True)


def replay(log: DataFrame, base: Keyspace | None = None) -> Keyspace:
    """Fold ``log`` (seq, ts, cmd, key, args array<string>) into a keyspace, from ``base`` if there is one.

    Text is the storage type here; binary strings travel as latin-1 text. Of a ``base`` the keys that the
    log touches are written out as commands before the log's own, and the others are carried over.
    """
    if base is None:
        return _folded(_commands(log), False)
    touched, got = replay_onto(log, base)
    return got.with_(**{name: rel.unionByName(other) for (name, rel), other in zip(got.relations().items(), as_text(base.without(touched)).relations().values())})


def as_text(ks: Keyspace) -> Keyspace:
    """``ks`` with text for binary values."""
    text = {"strings": "value", "hashes": "value", "lists": "value", "sets": "member"}
    return ks.with_(**{name: getattr(ks, name).withColumn(c, F.col(c).cast("string")) for name, c in text.items()})


def keyspace_of(rows: DataFrame) -> Keyspace:
    """The relations of the fold's rows."""
    of = lambda kind: rows.filter(F.col("type") == kind)
    return Keyspace(
        meta=rows.groupBy("key", "type").agg(F.max("expire_at").alias("expire_at")), strings=of("STRING").select("key", "value"), hashes=of("HASH").select("key", F.col("sub").alias("field"), "value"),
        lists=of("LIST").select("key", "pos", "value"), sets=of("SET").select("key", F.col("value").alias("member")), zsets=of("ZSET").select("key", F.col("sub").alias("member"), "score"),
    )


def as_commands(ks: Keyspace, per_command: int = 1) -> DataFrame:
    """Commands that make ``ks``: (seq, cmd, key, args), seq below zero in their order.

    With ``per_command`` above 1 the elements of a key are gathered, about so many a command, as a rewritten log has
    them. Long lists are always cut into commands of 1000 values, and the ends of keys follow as PEXPIREAT.
    """
    text = lambda c: F.col(c).cast("string")

    def gathered(rel: DataFrame, cmd: str, *parts) -> DataFrame:
        if per_command <= 1:
            return rel.select(F.lit(cmd).alias("cmd"), "key", F.lit(0).cast("bigint").alias("o"), F.array(*parts).alias("args"))
        many = rel.groupBy("key").agg(F.ceil(F.count("*") / F.lit(per_command)).alias("__n"))
        dealt = rel.join(many, "key").withColumn("__b", F.pmod(F.xxhash64(parts[-1] if cmd != "HSET" else parts[0]), F.col("__n")))
        return dealt.groupBy("key", "__b").agg(F.flatten(F.collect_list(F.array(*parts))).alias("args")).select(F.lit(cmd).alias("cmd"), "key", F.lit(0).cast("bigint").alias("o"), "args")

    parts = [
        ks.strings.select(F.lit("SET").alias("cmd"), "key", F.lit(0).cast("bigint").alias("o"), F.array(text("value")).alias("args")),
        gathered(ks.hashes, "HSET", F.col("field"), text("value")), gathered(ks.sets, "SADD", text("member")), gathered(ks.zsets, "ZADD", score_text(F.col("score")), F.col("member")),
    ]
    place = F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1
    pushed = ks.lists.withColumn("p", place).groupBy("key", F.floor(F.col("p") / 1000).alias("o")).agg(F.array_sort(F.collect_list(F.struct("p", text("value").alias("v")))).alias("vs"))
    parts.append(pushed.select(F.lit("RPUSH").alias("cmd"), "key", "o", F.transform("vs", lambda x: x["v"]).alias("args")))
    parts.append(ks.meta.filter("expire_at IS NOT NULL").select(F.lit("PEXPIREAT").alias("cmd"), "key", F.lit(1 << 40).alias("o"), F.array(text("expire_at")).alias("args")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select((F.col("o") - F.lit(1 << 41)).alias("seq"), "cmd", "key", "args")
