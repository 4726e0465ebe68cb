"""Path rules per repository."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.functions import globs
from repoatlas.settings import DEFAULT_EXCLUDE, DEFAULT_INCLUDE
from repoatlas.sources.workspace import written

# Repositories whose rules are sent to all tasks; each has some dozen patterns.
BROADCAST_REPOS = 20_000


def effective_rules(
    repos: DataFrame,
    rules: DataFrame,
    include=DEFAULT_INCLUDE,
    exclude=DEFAULT_EXCLUDE,
) -> DataFrame:
    """path_rules with the defaults filled in per repository and kind."""
    defaults = repos.select(
        "repo",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(kind).alias("kind"), F.lit(pattern).alias("pattern"))
                    for kind, patterns in (("include", include), ("exclude", exclude))
                    for pattern in patterns
                ]
            )
        ).alias("r"),
    ).select("repo", "r.kind", "r.pattern")
    own = rules.select("repo", "kind").distinct()
    return rules.select("repo", "kind", "pattern").unionByName(
        defaults.join(own, ["repo", "kind"], "left_anti")
    )


def folded_rules(rules: DataFrame) -> DataFrame:
    """One row a repository: an index of its include and exclude rules.

    Most rules say only how a path starts and ends, or what it holds: these are lists of texts.
    The others are kept as compiled, and come last. A null pattern is an explicitly empty list:
    it keeps the defaults out and accepts nothing.
    """
    rule = F.col("rule")
    simple = rule["exact"].isNull() & rule["pieces"].isNull() & (rule["head"] == "")
    middle = F.size(rule["between"])
    compiled = rules.where("pattern is not null").select(
        "repo", "kind", globs.compiled_rule(F.col("pattern")).alias("rule")
    )
    compiled = compiled.withColumn(
        "form",
        F.when(simple & (middle == 0), F.lit("ends"))
        .when(simple & (middle == 1) & (rule["tail"] == ""), F.lit("holds"))
        .otherwise(F.lit("other")),
    )

    def side(kind):
        def those(form, value):
            wanted = (F.col("kind") == kind) & (F.col("form") == form)
            return F.collect_list(F.when(wanted, value)).alias(form)

        return F.struct(
            those("ends", F.struct(rule["prefix"].alias("prefix"), rule["tail"].alias("text"))),
            those("holds", F.struct(rule["prefix"].alias("prefix"), rule["between"][0].alias("text"))),
            those("other", rule),
        )

    lists = compiled.groupBy("repo").agg(side("include").alias("include"), side("exclude").alias("exclude"))
    repos = rules.select(F.col("repo").alias("rule_repo")).distinct()
    return repos.join(lists, F.col("repo") == F.col("rule_repo"), "left").select(
        "rule_repo",
        *(
            F.coalesce(f"{kind}.{form}", F.array().cast(_list_type(lists, kind, form))).alias(f"{kind}_{form}")
            for kind in KINDS
            for form in FORMS
        ),
    )


KINDS, FORMS = ("include", "exclude"), ("ends", "holds", "other")


def _list_type(lists: DataFrame, kind: str, form: str):
    return lists.schema[kind].dataType[form].dataType


def _selected():
    path = F.col("path")

    def starts(r):
        # An empty prefix is what most rules have.
        return (r["prefix"] == "") | path.startswith(r["prefix"])

    def hit(kind):
        return (
            F.exists(f"{kind}_ends", lambda r: path.endswith(r["text"]) & starts(r))
            | F.exists(f"{kind}_holds", lambda r: path.contains(r["text"]) & starts(r))
            | F.exists(f"{kind}_other", lambda r: globs.rule_hits(path, r))
        )

    return hit("include") & ~hit("exclude")


def filter_by_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files of rule tables: no exclude rule of the repository may hit, some include must.

    A repository's rules are one row. If all rows fit a broadcast, files are tested where
    they are read and nothing is shuffled. Otherwise only (repo, path) meets the rules, and
    the content joins the selected paths by both, so no repository is a hot key for it.
    """
    folded = written(folded_rules(rules), "rules")
    same = F.col("repo") == F.col("rule_repo")
    if folded.count() <= BROADCAST_REPOS:
        joined = files.join(F.broadcast(folded), same).where(_selected())
        return joined.select(*(joined[c] for c in files.columns))
    narrow = files.select("repo", "path").join(folded, same).where(_selected())
    return files.join(narrow.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
