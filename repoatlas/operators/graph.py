"""Include resolution and the module dependency graph."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.functions import paths
from repoatlas.sources.workspace import written


def file_module_map(run_files: DataFrame, state_files: DataFrame | None) -> DataFrame:
    """(repo, path, module) of all known files; this run's rows override saved ones."""
    run = run_files.select("repo", "path", "module")
    if state_files is None:
        return run
    saved = state_files.select("repo", "path", F.col("module").alias("saved_module"))
    return run.join(saved, ["repo", "path"], "full_outer").select(
        "repo", "path", F.coalesce("module", "saved_module").alias("module")
    )


def _stored_candidates(imports: DataFrame) -> DataFrame:
    """Candidates are read three times by the joins; sources are lexed once for them."""
    return written(candidates(imports), "candidates")


def candidates(imports: DataFrame) -> DataFrame:
    """The two paths a local include may denote: as written, then from its directory."""
    return imports.withColumn("exact", F.col("name")).withColumn(
        "relative", paths.normalize_import(F.col("path"), F.col("name"))
    )


def _hits(cands: DataFrame, columns, file_map: DataFrame) -> DataFrame:
    """Known files among the candidate paths.

    Candidates are made distinct first, on the map side, so a header that everybody
    includes is one row here.
    """
    wanted = cands.select(
        "repo", F.explode(F.array_compact(F.array(*columns))).alias("target")
    ).distinct()
    return wanted.join(
        file_map.select("repo", F.col("path").alias("target"), "module"), ["repo", "target"]
    )


def _attach(cands: DataFrame, column: str, hits: DataFrame, out: str) -> DataFrame:
    """Left join on one candidate; rows without a candidate keep apart by their own path."""
    side = hits.select(
        "repo", F.col("target").alias("probe"), F.col("module").alias(out)
    )
    return (
        cands.withColumn(
            "probe", F.coalesce(F.col(column), F.concat(F.lit("\x00"), F.col("path")))
        )
        .join(side, ["repo", "probe"], "left")
        .drop("probe")
    )


def resolve_exact(imports: DataFrame, file_map: DataFrame) -> DataFrame:
    cands = _stored_candidates(imports)
    return _attach(cands, "exact", _hits(cands, ["exact"], file_map), "exact_module")


def resolve_relative(imports: DataFrame, file_map: DataFrame) -> DataFrame:
    cands = _stored_candidates(imports)
    return _attach(cands, "relative", _hits(cands, ["relative"], file_map), "relative_module")


def resolve_imports(imports: DataFrame, file_map: DataFrame) -> DataFrame:
    """Imports with ``target_module``: the path as written beats the relative one."""
    # Each pair of candidates is looked up once; includes are moved once, to their pair.
    cands = _stored_candidates(imports)
    key = ["repo", "exact", "relative"]
    pairs = cands.select(*key).distinct().withColumn("path", F.col("exact"))
    hits = _hits(pairs, ["exact", "relative"], file_map)
    both = _attach(
        _attach(pairs, "exact", hits, "exact_module"), "relative", hits, "relative_module"
    )
    found = both.select(*(F.col(k).alias(f"of_{k}") for k in key), "exact_module", "relative_module")
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key]
    joined = cands.join(found, same, "left").drop(*(f"of_{k}" for k in key))
    return joined.withColumn("target_module", F.coalesce("exact_module", "relative_module"))


def module_edges(imports: DataFrame, file_map: DataFrame) -> DataFrame:
    """Distinct module_edges(repo, src_module, dst_module), no self edges.

    ``imports`` must carry the importing file's ``module``. Includes shrink to distinct
    (module, candidate paths) before any join, so the joins see each popular header once
    per module.
    """
    # Files of one folder that include the same name mean the same file.
    folder = paths.parent_dir(F.col("path"))
    per_folder = (
        imports.where(~F.col("is_system"))
        .select("repo", "module", F.concat_ws("/", folder, F.lit("_")).alias("path"), "name")
        .distinct()
    )
    wanted = written(
        candidates(per_folder).select("repo", "module", "exact", "relative").distinct(),
        "candidates",
    ).withColumn("path", F.col("exact"))
    hits = _hits(wanted, ["exact", "relative"], file_map)
    both = _attach(
        _attach(wanted.withColumnRenamed("module", "src_module"), "exact", hits, "exact_module"),
        "relative",
        hits,
        "relative_module",
    )
    return edges_from_resolved(
        both.withColumn("target_module", F.coalesce("exact_module", "relative_module"))
    )


def edges_from_resolved(resolved: DataFrame) -> DataFrame:
    target = F.col("target_module")
    return (
        resolved.where(target.isNotNull() & (target != F.col("src_module")))
        .select("repo", "src_module", target.alias("dst_module"))
        .distinct()
    )


def dependents_in_run(edges: DataFrame, run_modules: DataFrame) -> DataFrame:
    """Edges whose target is one of this run's modules."""
    return edges.join(
        run_modules.select("repo", F.col("module").alias("dst_module")).distinct(),
        ["repo", "dst_module"],
        "left_semi",
    )


def related(edges: DataFrame, run_modules: DataFrame) -> DataFrame:
    """(repo, module, side, other): both directions of the graph as rows.

    Dependents are only recorded for modules of this run.
    """
    forward = edges.select(
        "repo",
        F.col("src_module").alias("module"),
        F.lit("depends_on").alias("side"),
        F.col("dst_module").alias("other"),
    )
    backward = dependents_in_run(edges, run_modules).select(
        "repo",
        F.col("dst_module").alias("module"),
        F.lit("depended_by").alias("side"),
        F.col("src_module").alias("other"),
    )
    return forward.unionByName(backward)


def degrees(edges: DataFrame, run_modules: DataFrame) -> DataFrame:
    """In and out degree of every module of the run."""
    counts = (
        related(edges, run_modules)
        .groupBy("repo", "module")
        .agg(
            F.count_if(F.col("side") == "depends_on").alias("n_dependencies"),
            F.count_if(F.col("side") == "depended_by").alias("n_dependents"),
        )
    )
    zero = F.lit(0).cast("long")
    return (
        run_modules.select("repo", "module")
        .distinct()
        .join(counts, ["repo", "module"], "left")
        .select(
            "repo",
            "module",
            F.coalesce("n_dependencies", zero).alias("n_dependencies"),
            F.coalesce("n_dependents", zero).alias("n_dependents"),
        )
    )
