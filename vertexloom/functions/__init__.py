"""Column functions of the data model: ownership of vertices, labels, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Owners of the default four-way partitioning.
OWNERS = 4


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def owner(vertex: Column | str, owners: int = OWNERS) -> Column:
    """The partition that owns a vertex: its id modulo their number."""
    return F.pmod(_col(vertex), F.lit(owners)).cast("int")


def local_id(vertex: Column | str, owners: int = OWNERS) -> Column:
    """A vertex's place at its owner."""
    return F.floor(_col(vertex) / owners).cast("long")


def global_id(local: Column | str, rank: Column | str, owners: int = OWNERS) -> Column:
    """The inverse of ``owner`` and ``local_id``."""
    return (_col(local) * owners + _col(rank)).cast("long")


def shown_distance(hop: Column | str) -> Column:
    """Distance as the reports show it: 0 for the source, hop + 1 beyond, -1 where unreached."""
    h = _col(hop)
    return F.when(h > 0, h + 1).otherwise(h).cast("int")


def percent(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole, 0 for an empty whole."""
    p, w = _col(part), _col(whole)
    return F.when(w > 0, 100.0 * p / F.nullif(w, F.lit(0))).otherwise(0.0)


def size_bucket(size: Column | str) -> Column:
    """Size class of a component."""
    s = _col(size)
    return F.when(s == 1, "single").when(s <= 10, "2-10").when(s <= 100, "11-100").otherwise(">100")


BUCKETS = ("single", "2-10", "11-100", ">100")


def dataset_label(name: Column | str) -> Column:
    """``g500-scaleNN`` as ``SNN``, other names trimmed."""
    n = F.trim(_col(name))
    return F.when(n.contains("g500-scale"), F.concat(F.lit("S"), F.substring_index(n, "scale", -1))).otherwise(n)


def guarded_ratio(above: Column | str, below: Column | str) -> Column:
    """above / below, 0 where below isn't positive."""
    a, b = _col(above), _col(below)
    return F.when(b > 0, a / F.nullif(b, F.lit(0.0))).otherwise(0.0)


def implementation_label(file: Column | str) -> Column:
    """Which program wrote a log, by its file name."""
    # Suffixes and labels; the last two are those of this engine's own suite.
    f = _col(file)
    own = F.when(f.endswith("_task.out"), "TASK").when(f.endswith("_rounds.out"), "ROUNDS")
    return F.when(f.endswith("_gpu_stf.out"), "GPU_STF").when(f.endswith("_gpu.out"), "GPU").when(f.endswith("_cpu.out"), "CPU").otherwise(own)
