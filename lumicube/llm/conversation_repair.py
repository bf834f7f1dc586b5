"""Conversation structure repair: the cheapest edits that give every conversation the roles ``(system? (user assistant)+)?``.

Rows are judged by windows (blank, duplicate, truncated, illegal neighbours).  The sorted turns of a conversation are
then folded with ``aggregate()``, which carries four (cost, audit) structs, one for each thing that may have been said
last: nothing, the system turn, a user's turn, an assistant's turn.  Each step takes the ``least`` of the ways into a
state; as structs compare by cost and then by audit, ties go to the audit that is smallest in ASCII.  An insertion is
made as late as possible, which never costs more and sorts first (``D`` before ``I``).

A conversation of more than BLOCK turns isn't gathered: its rows are range-partitioned in order and cut into blocks;
each block is folded from all four states, a second fold over the blocks picks the path, and each block writes its own
part of the repaired turns.  Only the audit, which is one value by definition, and its digest grow with a conversation;
the digest reads lines as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ._spark import cut, hot_keys, salted_join

#: Turns that are gathered in one row at most.
BLOCK = 256
#: Costs of the edits, and of an undeleted truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Cost of a state that can't be reached.
FAR = 1 << 60
STATES = "nsua"
WHITE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows with reproducible faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (copies 0), 1 empties the text, 2 removes its ``.!?``, 3 repeats the row (copies 2), 4 makes the
    role user.  A null is read as one space, but for the turn's order.  Repeated rows get the same fault; other columns
    are not read; an empty table gives no rows.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return rows.select(
        F.col("conv_id"), F.col("turn"), F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _rows(rows: DataFrame) -> DataFrame:
    """The rows as read by the operator: ``key`` stands for the conversation, ``known`` sorts null turns first."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    base = rows.select(
        F.col("conv_id"), blank("conv_id").alias("key"), F.col("turn").isNotNull().alias("known"), F.col("turn").cast("long").alias("turn"),
        blank("role").alias("role"), blank("text").alias("text"), copies.cast("int").alias("copies"),
    )
    said = F.btrim("text", F.lit(WHITE))
    return base.withColumns({"initial": F.substring("role", 1, 1), "blank": said == "", "open": ~F.substring(said, -1, 1).isin(".", "!", "?")})


def _turn() -> Column:
    """What the fold reads of a turn; ``must`` marks what has to be deleted."""
    must = F.col("blank") | F.col("again")
    extra = F.when(F.col("open"), TRUNCATED).otherwise(0)
    price = lambda c: F.when(must, F.lit(FAR)).otherwise((F.when(F.col("initial") == c, 0).otherwise(REROLE) + extra).cast("long"))
    edit = lambda c: F.when(F.col("initial") == c, "K").otherwise("R")
    system = F.when(~must & (F.col("initial") == "s"), extra.cast("long")).otherwise(F.lit(FAR))
    return F.struct("known", "turn", "role", "text", "initial", price("u").alias("uc"), edit("u").alias("ue"), price("a").alias("ac"), edit("a").alias("ae"), system.alias("sc"))


def _pair(cost: Column, audit: Column) -> Column:
    return F.struct(cost.alias("cost"), audit.alias("audit"))


def _then(state: Column, cost: Column, letters: Column) -> Column:
    return _pair(state["cost"] + cost, F.concat(state["audit"], letters))


def _start(entry: Column) -> Column:
    at = lambda s: _pair(F.when(entry == s, F.lit(0).cast("long")).otherwise(F.lit(FAR)), F.lit(""))
    return F.struct(*(at(s).alias(s) for s in STATES))


def _step(state: Column, t: Column) -> Column:
    gone = lambda s: _then(state[s], F.lit(DELETE), F.lit("D"))
    new = lambda s: _then(state[s], F.lit(INSERT), F.lit("I"))
    user = F.least(state["n"], state["s"], state["a"], new("u"))
    assistant = F.least(state["u"], new("n"), new("s"), new("a"))
    return F.struct(
        gone("n").alias("n"),
        F.least(gone("s"), _then(state["n"], t["sc"], F.lit("K"))).alias("s"),
        F.least(gone("u"), _then(user, t["uc"], t["ue"])).alias("u"),
        F.least(gone("a"), _then(assistant, t["ac"], t["ae"])).alias("a"),
    )


def _fold(turns: Column, entry: Column) -> Column:
    """The four cheapest (cost, audit) after ``turns``, started in the state ``entry``."""
    return F.aggregate(turns, _start(entry), _step)


def _end(state: Column) -> Column:
    """The cheapest way to stop: as it is, or with the turns that are missing."""
    return F.least(state["n"], state["a"], _then(state["u"], F.lit(INSERT), F.lit("I")), _then(state["s"], F.lit(2 * INSERT), F.lit("II")))


def _repaired(turns: Column, audit: Column, entry: Column) -> Column:
    """array<struct<role, text>> of the turns after the edits ``audit`` in the state ``entry``."""
    head = F.length(audit) - F.length(F.ltrim(audit, F.lit("D"))) + 1  # the first edit that isn't a deletion
    system = (F.substr(audit, head, F.lit(1)) == "K") & (F.try_element_at(turns, head)["initial"] == "s")
    shift = system.cast("int") + (entry == "u").cast("int")

    def made(k: Column) -> Column:
        letter, upto = F.substr(audit, k, F.lit(1)), F.substr(audit, F.lit(1), k)
        at = F.length(F.translate(upto, "I", ""))
        turn = F.try_element_at(turns, F.greatest(at, F.lit(1)))
        role = F.when((F.length(F.translate(upto, "D", "")) + shift) % 2 == 1, "user").otherwise("assistant")
        return F.when(letter == "K", F.struct(turn["role"].alias("role"), turn["text"].alias("text"))).when(
            letter == "R", F.struct(role.alias("role"), turn["text"].alias("text"))
        ).when(letter == "I", F.struct(role.alias("role"), F.lit("").alias("text")))

    none = F.array().cast("array<struct<role:string,text:string>>")
    return F.when(F.length(audit) > 0, F.filter(F.transform(F.sequence(F.lit(1), F.length(audit)), made), lambda x: x.isNotNull())).otherwise(none)


def _short(rows: DataFrame) -> DataFrame:
    """The report of conversations of a bounded number of turns, one row each; one shuffle by conversation."""
    n = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array(F.lit(0)))
    each = rows.repartition("key").withColumn("copy", F.explode(n)).withColumn("there", F.col("copy") > 0)
    same = Window.partitionBy("key", "there", "role", "text").orderBy("known", "turn")
    order = Window.partitionBy("key", "there").orderBy("known", "turn", "role", "text")
    flagged = (
        each.withColumn("again", ~F.col("blank") & (F.row_number().over(same) > 1))
        .withColumns({"before": F.lag("initial").over(order), "last": F.lag("turn").over(order)})
        .withColumn("new", F.col("known") & (F.col("last").isNull() | (F.col("last") != F.col("turn"))))
    )
    there, count = F.col("there"), lambda c: F.count(F.when(F.col("there") & c, 1))
    found = flagged.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max(F.when(there, F.col("turn"))) - F.min(F.when(there, F.col("turn"))) + 1 - count(F.col("new")), F.lit(0)).alias("gaps"),
        count(F.col("blank")).alias("blank"), count(F.col("again")).alias("duplicate"),
        count(F.col("open") & ~F.col("blank") & ~F.col("again")).alias("truncated"),
        count(F.col("before").isNotNull() & ~F.concat("before", "initial").isin(*LEGAL)).alias("illegal"),
        F.array_sort(F.collect_list(F.when(there, _turn()))).alias("turns"),
    )
    best = found.withColumn("best", _end(_fold(F.col("turns"), F.lit("n"))))
    return best.select(
        "conv_id", F.lit(0).alias("part"), "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"),
        F.col("best.audit").alias("audit"), _repaired(F.col("turns"), F.col("best.audit"), F.lit("n")).alias("repaired"),
    )


def _again(rows: DataFrame) -> DataFrame:
    """Rows of long conversations, one a copy, with ``again``: equal rows are counted before they are shuffled."""
    by = ["key", "role", "text"]
    counted = cut(rows.filter("copies > 0").groupBy("conv_id", *by, "known", "turn", "initial", "blank", "open").agg(F.sum("copies").alias("copies")))
    same = counted.groupBy(*by).agg(F.min(F.struct("known", "turn")).alias("first"), F.count("*").alias("n"))
    with_first = salted_join(counted, same.drop("n"), by, hot_keys(same, by), ["known", "turn"])
    each = with_first.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    first = (F.col("copy") == 1) & F.col("first").eqNullSafe(F.struct("known", "turn"))
    return each.withColumn("again", ~F.col("blank") & ~first).drop("copies", "copy", "first")


def _blocks(rows: DataFrame) -> DataFrame:
    """(key, block, turns): runs of at most BLOCK turns of a conversation, in order by ``block``."""
    order = ["key", "known", "turn", "role", "text", "again"]
    sorted_ = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    block = F.floor(F.col("place") / BLOCK)  # a partition's places start at a multiple of 2**33
    turns = F.transform(F.array_sort(F.collect_list(F.struct("place", _turn().alias("t")))), lambda x: x["t"])
    return sorted_.groupBy("key", block.alias("block")).agg(turns.alias("turns"))


def _joined(state: Column, block: Column) -> Column:
    """The four (cost, audit, path) after one more block; a path names the state after each block."""

    def way(i: int, j: str) -> Column:
        step = block["m"][i][j]
        return F.struct(
            (state[STATES[i]]["cost"] + step["cost"]).alias("cost"), F.concat(state[STATES[i]]["audit"], step["audit"]).alias("audit"), F.concat(state[STATES[i]]["path"], F.lit(j)).alias("path")
        )

    return F.struct(*(F.least(*(way(i, j) for i in range(4))).alias(j) for j in STATES))


def _long(rows: DataFrame) -> DataFrame:
    """The report of long conversations, one row a block; counts stand in each, ``audit`` and ``repaired`` are the block's own."""
    each = cut(_again(rows))
    turns = each.groupBy("key", "known", "turn").agg(F.first("conv_id").alias("conv_id"), *(F.count(F.when(c, 1)).alias(n) for n, c in (
        ("blank", F.col("blank")), ("duplicate", F.col("again")), ("truncated", F.col("open") & ~F.col("blank") & ~F.col("again"))
    )))
    counts = turns.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count(F.when(F.col("known"), 1)), F.lit(0)).alias("gaps"),
        *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")),
    )
    entries = F.array(*map(F.lit, STATES))
    wrong = lambda a, b: (~F.concat(a, b).isin(*LEGAL)).cast("long")
    inner = F.aggregate(F.col("turns"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("last")), lambda s, t: F.struct(
        (s["n"] + F.coalesce(wrong(s["last"], t["initial"]), F.lit(0))).alias("n"), t["initial"].alias("last")
    ))
    blocks = cut(_blocks(each).withColumns({"m": F.transform(entries, lambda e: _fold(F.col("turns"), e)), "inner": inner["n"]}))
    ends = F.struct("block", "m", "inner", F.col("turns")[0]["initial"].alias("first"), F.element_at("turns", -1)["initial"].alias("last"))
    start = F.struct(*(F.struct(F.lit(0 if s == "n" else FAR).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("path")).alias(s) for s in STATES))
    seam = lambda s, b: F.struct((s["n"] + b["inner"] + F.coalesce(wrong(s["last"], b["first"]), F.lit(0))).alias("n"), b["last"].alias("last"))
    found = blocks.groupBy("key").agg(F.array_sort(F.collect_list(ends)).alias("list")).withColumns({
        "state": F.aggregate("list", start, _joined),
        "illegal": F.aggregate("list", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("last")), seam)["n"],
    })
    stop = lambda s, c, x: F.struct((F.col("state")[s]["cost"] + c).alias("cost"), F.concat(F.col("state")[s]["audit"], F.lit(x)).alias("audit"), F.col("state")[s]["path"].alias("path"), F.lit(x).alias("tail"))
    chosen = found.withColumn("best", F.least(stop("n", 0, ""), stop("a", 0, ""), stop("u", INSERT, "I"), stop("s", 2 * INSERT, "II")))
    places = chosen.select("key", "illegal", F.col("best.cost").alias("cost"), F.concat(F.lit("n"), "best.path").alias("path"), F.col("best.tail").alias("tail"), F.size("list").alias("parts"), F.posexplode("list.block").alias("part", "block"))
    entry, leave = F.substr("path", F.col("part") + 1, F.lit(1)), F.substr("path", F.col("part") + 2, F.lit(1))
    own = places.select("key", "block", "part", "illegal", "cost", entry.alias("entry"), leave.alias("leave"), F.when(F.col("part") == F.col("parts") - 1, F.col("tail")).otherwise("").alias("tail"))
    picked = [F.when((F.col("entry") == e) & (F.col("leave") == x), F.col("m")[i][x]["audit"]) for i, e in enumerate(STATES) for x in STATES]
    audit = F.concat(F.coalesce(*picked), F.col("tail"))
    parts = blocks.join(own, ["key", "block"]).withColumn("audit", audit).join(counts, "key")
    return parts.select("conv_id", "part", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", _repaired(F.col("turns"), F.col("audit"), F.col("entry")).alias("repaired"))


def _both(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    base = _rows(rows)
    sizes = base.groupBy("key").agg(F.sum("copies").alias("n")).filter(F.col("n") > BLOCK)
    long = cut(sizes.select("key"))
    if long.isEmpty():
        return _short(base), None
    return _short(base.join(long, "key", "left_anti")), _long(base.join(long, "key", "left_semi"))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, part, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (array of role and text).

    One row (part 0) for each conversation of up to BLOCK turns; a longer one has a row for each block, with the counts
    of the whole conversation and the block's own edits and repaired turns.  Rows stand in the order of turn, nulls
    first, then role and text by their bytes.  The first fault of a row counts: blank (white space alone), duplicate
    (role and text stood before), truncated (doesn't end with ``.!?``).  A null role, text or id is read as one space;
    rows with a null id are one conversation.  A role counts by its first letter, in lower case only; an empty role is
    none.  A column ``copies`` says how often a row stands (0: only its id is reported); other columns are not read.
    Repeated rows are duplicates; very long texts are only carried; an empty table gives no rows.
    """
    short, long = _both(rows)
    return short if long is None else short.unionByName(long)


def _line(x: Column) -> Column:
    return F.concat(x["role"], F.lit(":"), x["text"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each key; keys stand together and lines in order, so one running hash is held."""
    key, run = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for k, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if run is not None:
                    done.append((key, run.hexdigest()))
                key, run = k, hashlib.sha256(line.encode())
            else:
                run.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], names=["key", "sha"])
    if run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([run.hexdigest()])], names=["key", "sha"])


def digests(rows: DataFrame) -> DataFrame:
    """The report of ``repair``, one row a conversation, with ``repaired_sha256`` of the lines ``role:text`` for its turns.

    No turns give the digest of the empty string.  All else as for ``repair``.
    """
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    short, long = _both(rows)
    out = short.select(*names, "audit", F.sha2(F.concat_ws("\n", F.transform("repaired", _line)), 256).alias("repaired_sha256"))
    if long is None:
        return out
    parts = cut(long.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))))
    whole = parts.groupBy("key", *names).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"])).alias("audit"))
    lines = parts.select("key", "part", F.posexplode("repaired").alias("n", "turn")).select("key", "part", "n", _line(F.col("turn")).alias("line"))
    hashes = lines.repartition("key").sortWithinPartitions("key", "part", "n").select("key", "line").mapInArrow(_hashed, "key string, sha string")
    sha = F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return out.unionByName(whole.join(hashes, "key", "left").select(*names, "audit", sha))


def oracle() -> str:
    """DuckDB SQL of the query: crc32 by bits, faults by windows, and the fold as a recursion over the turns."""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    crc = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295) % 20"""
    far = 10**15

    def then(s: str, cost: str, letters: str) -> str:
        return f"{{'c': f.{s}.c + {cost}, 'e': f.{s}.e || {letters}}}"

    def least(*xs: str) -> str:
        return f"list_sort([{', '.join(xs)}])[1]"

    gone = {s: then(s, str(DELETE), "'D'") for s in STATES}
    user = [then(s, "t.uc", "t.ue") for s in "nsa"] + [then("u", f"{INSERT} + t.uc", "'I' || t.ue")]
    assistant = [then("u", "t.ac", "t.ae")] + [then(s, f"{INSERT} + t.ac", "'I' || t.ae") for s in "nsa"]
    first = ", ".join(f"{{'c': {0 if s == 'n' else far}::BIGINT, 'e': ''}} AS {s}" for s in STATES)
    return f"""
WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT *, {crc} AS kind FROM base),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded),
seen AS (SELECT *, substr(role, 1, 1) AS i, trim(text, {white}) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM hurt),
judged AS (SELECT *, said = '' AS blank, said <> '' AND nth > 1 AS again, said <> '' AND nth = 1 AND right(said, 1) NOT IN ('.', '!', '?') AS open,
    lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM seen),
priced AS (SELECT *, CASE WHEN blank OR again THEN {far} ELSE CASE WHEN i = 'u' THEN 0 ELSE {REROLE} END + open::INT END AS uc, CASE WHEN i = 'u' THEN 'K' ELSE 'R' END AS ue,
    CASE WHEN blank OR again THEN {far} ELSE CASE WHEN i = 'a' THEN 0 ELSE {REROLE} END + open::INT END AS ac, CASE WHEN i = 'a' THEN 'K' ELSE 'R' END AS ae,
    CASE WHEN blank OR again OR i <> 's' THEN {far} ELSE open::INT END AS sc FROM judged),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
    count(*) FILTER (open) AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM priced GROUP BY conv_id),
fold AS (SELECT conv_id, 0::BIGINT AS pos, {first} FROM counts
  UNION ALL SELECT f.conv_id, t.pos, {gone['n']}, {least(gone['s'], then('n', 't.sc', "'K'"))}, {least(gone['u'], *user)}, {least(gone['a'], *assistant)}
  FROM fold f JOIN priced t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.pos = f.pos + 1),
best AS (SELECT f.conv_id, {least("f.n", "f.a", then('u', str(INSERT), "'I'"), then('s', str(2 * INSERT), "'II'"))} AS b FROM fold f JOIN counts c ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = c.n),
edits AS (SELECT conv_id, k, b.e[k] AS e, length(replace(b.e[1:k], 'I', '')) AS pos, length(replace(b.e[1:k], 'D', '')) AS o FROM (SELECT *, unnest(range(1, length(b.e) + 1)) AS k FROM best)),
made AS (SELECT x.*, t.role, t.text, max(CASE WHEN x.e = 'K' AND x.o = 1 AND t.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.conv_id) AS lead
  FROM edits x LEFT JOIN priced t ON t.conv_id IS NOT DISTINCT FROM x.conv_id AND t.pos = x.pos AND x.e <> 'I' WHERE x.e <> 'D'),
texts AS (SELECT conv_id, string_agg((CASE WHEN e = 'K' THEN role WHEN (o + lead) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS whole FROM made GROUP BY conv_id)
SELECT d.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
  coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.b.c, 0)::BIGINT AS cost, coalesce(b.b.e, '') AS audit, sha256(coalesce(t.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM d.conv_id"""
