"""Models by role: who may judge whom, and the order of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def eligible(targets: DataFrame, panel: DataFrame) -> DataFrame:
    """model, judge, same_family: the whole panel (judge, family) judges every target (model, family); whether both are of one
    family is told and excludes none. The panel is a handful of judges, joined under a constant key."""
    return targets.select("model", F.col("family").alias("_f"), F.lit(1).alias("_k")).join(panel.select("judge", "family", F.lit(1).alias("_k")), "_k").select("model", "judge", F.coalesce(F.col("_f") == F.col("family"), F.lit(False)).alias("same_family"))


def conflicts(roles: DataFrame) -> DataFrame:
    """rule, level, model: what is wrong with a table of model, role and family; empty if nothing is.

    Errors: the teacher judges (`teacher_judges`), the teacher picks pairs (`teacher_pairs`), the judge of pairs judges
    (`pair_judge_judges`). Warnings: a judge is trained itself (`judge_trained`), a judge's family is trained
    (`judge_family_trained`), judges share a family (`family_twice`), the extractor judges (`extractor_judges`).
    Roles: teacher, pair_judge, judge, trained, extractor.
    """
    of = lambda role: roles.where(F.col("role") == role).select("model", "family").distinct()
    judges, trained = of("judge"), of("trained")
    say = lambda df, rule, level: df.select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), "model")
    both = lambda a, b: of(a).join(of(b), "model", "left_semi")
    own = judges.join(trained, "model", "left_semi")
    family = judges.join(trained, "model", "left_anti").join(trained.select("family").distinct(), "family", "left_semi")
    twice = judges.join(judges.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "family", "left_semi")
    out = say(both("teacher", "judge"), "teacher_judges", "error")
    for df, rule, level in (
        (both("teacher", "pair_judge"), "teacher_pairs", "error"), (both("pair_judge", "judge"), "pair_judge_judges", "error"), (own, "judge_trained", "warning"), (family, "judge_family_trained", "warning"),
        (twice, "family_twice", "warning"), (both("extractor", "judge"), "extractor_judges", "warning"),
    ):
        out = out.unionByName(say(df, rule, level))
    return out


def assert_roles(roles: DataFrame) -> list[str]:
    """Raises for an error among the roles; else the warnings, which are as few as there are models."""
    found = conflicts(roles).collect()
    if bad := [f"{r['rule']}: {r['model']}" for r in found if r["level"] == "error"]:
        raise ValueError("; ".join(sorted(bad)))
    return sorted(f"{r['rule']}: {r['model']}" for r in found)


def levels(nodes: DataFrame, most: int = 64) -> DataFrame:
    """name, parent, level of a table of name and parent: how many must end before each; null parents begin.

    Breadth first, one join for each level; each level is written down, so that plans stay short. Nodes that hang on a cycle
    or on a parent that is missing have level null. More than `most` levels are an error.
    """
    done = materialize(nodes.where("parent is null").select("name", "parent", F.lit(0).alias("level")), "dag")
    front, rest = done, nodes.where("parent is not null").select("name", "parent")
    for depth in range(1, most + 1):
        front = materialize(rest.join(front.select(F.col("name").alias("parent")).distinct(), "parent", "left_semi").select("name", "parent", F.lit(depth).alias("level")), "dag")
        if front.isEmpty():
            break
        done = done.unionByName(front)
    else:
        raise ValueError(f"more than {most} levels")
    return done.unionByName(rest.join(done.select("name"), "name", "left_anti").select("name", "parent", F.lit(None).cast("int").alias("level")))
