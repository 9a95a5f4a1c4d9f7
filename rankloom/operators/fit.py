"""Which items fit a capacity: need, class, sorted views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes a parameter by storage form, what running needs besides, and common machines.
BYTES = {"q4": 0.55, "q8": 1.0, "fp16": 2.0}
OVERHEAD, TIGHT, SHARED = 1.2, 1.12, 0.75
NOTES = {"fits": "runs on GPU", "tight": "tight — trim context", "offload": "CPU / partial offload (slower)", "toobig": "exceeds RAM at this quant"}
MACHINES = [
    ("Custom", None, False), ("RTX 5090 · 32GB", 32.0, False), ("RTX 4090 / 3090 · 24GB", 24.0, False), ("RTX 5080 / 4080 · 16GB", 16.0, False), ("RTX 4070 Ti / 3060 · 12GB", 12.0, False),
    ("RTX 4060 / 3050 · 8GB", 8.0, False), ("Apple M-series (unified)", 0.0, True), ("A100 · 40GB", 40.0, False), ("A100 / H100 · 80GB", 80.0, False), ("CPU only", 0.0, False),
]


@dataclass(frozen=True)
class Machine:
    vram: float = 24.0
    ram: float = 32.0
    quant: str = "q4"
    unified: bool = False

    @property
    def budget(self) -> float:
        return self.ram * SHARED if self.unified else self.vram


def machines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MACHINES, "label string, vram double, unified boolean")


def preset(label: str, machine: Machine = Machine()) -> Machine:
    """The machine after a preset is chosen; one without a size leaves the machine's own."""
    vram, unified = next((v, u) for name, v, u in MACHINES if name == label)
    return Machine(machine.vram if vram is None and not unified else 0.0 if unified else vram, machine.ram, machine.quant, unified)


def fitted(df: DataFrame, m: Machine) -> DataFrame:
    """need, fit and note of every row that is local, of known size over 0 and not noise."""
    size = F.col("params_b")
    need = size * BYTES[m.quant] * OVERHEAD
    fit = F.when(F.col("need") <= m.budget, "fits").when(F.col("need") <= m.budget * TIGHT, "tight").when(size * BYTES[m.quant] <= m.ram, "offload").otherwise("toobig")
    note = F.create_map(*[F.lit(x) for kv in NOTES.items() for x in kv])
    rows = df.where(F.col("local") & (size != 0) & ~F.coalesce("noise", F.lit(False))).withColumn("need", need)
    return rows.withColumn("fit", fit).withColumn("note", note[F.col("fit")])


def fit_view(df: DataFrame, m: Machine, use: str = "score", near: int = 8) -> DataFrame:
    """What runs, best first by `use`, then by score, then rank; below, the best `near` of the rest. pos numbers all."""
    from rankloom.operators.score import numbered

    every = fitted(df, m)
    runs = F.col("fit").isin("fits", "tight")
    score = F.coalesce("score", F.lit(0.0))
    above = every.where(runs).withColumns({"section": F.lit(1), "_a": F.coalesce(F.col(use).cast("double"), F.lit(-1.0)), "_b": score})
    below = every.where(~runs).withColumns({"section": F.lit(2), "_a": score, "_b": F.lit(0.0)}).orderBy(score.desc(), "rank").limit(near)
    order = [F.col("section").asc(), F.col("_a").desc(), F.col("_b").desc(), F.col("rank").asc()]
    return numbered(above.unionByName(below), order, "pos").drop("_a", "_b")


def best_pick(df: DataFrame, m: Machine, use: str = "score") -> DataFrame:
    runs = fitted(df, m).where(F.col("fit").isin("fits", "tight"))
    return runs.orderBy(F.coalesce(F.col(use).cast("double"), F.lit(-1.0)).desc(), F.coalesce("score", F.lit(0.0)).desc(), "rank").limit(1)


def largest_fitting(m: Machine) -> float:
    """The size, in billions, that just fits."""
    return m.budget / (BYTES[m.quant] * OVERHEAD)


def fit_summary(df: DataFrame, m: Machine, use: str = "score") -> str:
    """The best pick in a line, or what would fit if nothing does."""
    best = best_pick(df, m, use).select("name", "params_b", "need", "score").first()
    kind = "UNIFIED" if m.unified else "VRAM"
    if best is None:
        return f"Nothing fits {m.budget:.0f}GB at {m.quant.upper()}. Try a smaller quant, or a model under ~{largest_fitting(m):.0f}B params."
    return f"BEST PICK FOR {m.budget:.0f}GB {kind} @ {m.quant.upper()}: {best.name} · {best.params_b}B params · ~{best.need:.1f}GB to load · score {'—' if best.score is None else best.score}"


def fit_line(df: DataFrame, m: Machine) -> DataFrame:
    """One row, text: how many models fit, of how many of known size, and how needs are estimated."""
    n = fitted(df, m).agg(F.count_if(F.col("fit").isin("fits", "tight")).alias("fit"), F.count("*").alias("all"))
    return n.select(F.concat(F.col("fit"), F.lit(" MODELS FIT · "), F.col("all"), F.lit(f" OPEN-WEIGHT MODELS WITH KNOWN SIZE · EST. VRAM = PARAMS × {BYTES[m.quant]:g}B × {OVERHEAD:g} OVERHEAD")).alias("text"))
