"""Hybrid logical clocks: `wall(15):counter(6):node`, whose text order is their causal order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = "^[0-9]{15}:[0-9]{6}:[A-Za-z0-9._~-]{0,64}$"
MOST_COUNTER = 999_999


def encode(wall: Column, counter: Column, node: Column) -> Column:
    """The stamp; a counter beyond its width is carried to the wall."""
    over = F.lit(MOST_COUNTER + 1)
    whole, rest = wall + F.floor(counter / over), counter % over
    return F.concat_ws(":", F.lpad(whole.cast("string"), 15, "0"), F.lpad(rest.cast("string"), 6, "0"), node)


def valid(stamp: Column) -> Column:
    return F.coalesce(stamp.rlike(PATTERN), F.lit(False))


def parse(stamp: Column) -> dict[str, Column]:
    """wall, counter and node; null where the text is malformed."""
    ok = valid(stamp)
    return {
        "wall": F.when(ok, F.substring(stamp, 1, 15).cast("long")),
        "counter": F.when(ok, F.substring(stamp, 17, 6).cast("int")),
        "node": F.when(ok, F.substring(stamp, 24, 64)),
    }


def carried(wall: Column, counter: Column) -> tuple[Column, Column]:
    """A counter beyond its width borrows from the wall."""
    return F.when(counter > MOST_COUNTER, wall + 1).otherwise(wall), F.when(counter > MOST_COUNTER, 0).otherwise(counter)


def receive_fold(steps: Column, most_drift: int | None = None, wall: Column | int = 0) -> Column:
    """The clock after an array of steps struct(physical, remote_wall, remote_counter); a null remote is a local event.

    wall: where the clock stands before, with a counter of 0.

    Returns struct(wall, counter, refused): a remote stamp further ahead of the physical time than most_drift is refused.
    """
    wall = wall if isinstance(wall, Column) else F.lit(wall)
    zero = F.struct(wall.cast("long").alias("wall"), F.lit(0).cast("long").alias("counter"), F.lit(0).cast("long").alias("refused"))

    def step(clock: Column, s: Column) -> Column:
        local, remote = s["remote_wall"].isNull(), F.coalesce(s["remote_wall"], F.lit(-1))
        wall = F.greatest(clock["wall"], s["physical"], remote)
        at_own, at_remote = wall == clock["wall"], ~local & (wall == remote)
        counter = (
            F.when(at_own & at_remote, F.greatest(clock["counter"], s["remote_counter"]) + 1).when(at_own, clock["counter"] + 1).when(at_remote, s["remote_counter"] + 1).otherwise(F.lit(0))
        ).cast("long")
        w, c = carried(wall, counter)
        moved = F.struct(w.cast("long").alias("wall"), c.cast("long").alias("counter"), clock["refused"].alias("refused"))
        if most_drift is None:
            return moved
        ahead = ~local & (remote - s["physical"] > most_drift)
        return F.when(ahead, F.struct(clock["wall"].alias("wall"), clock["counter"].alias("counter"), (clock["refused"] + 1).alias("refused"))).otherwise(moved)

    return F.aggregate(steps, zero, step)


def correction(server_time: Column, sent: Column, received: Column, least: int = 1000) -> Column:
    """Milliseconds to add to the device clock: only if it runs ahead of the server by at least `least`."""
    offset = server_time - F.floor((sent + received) / 2)
    return F.when(offset <= -least, offset).otherwise(F.lit(0)).cast("long")
