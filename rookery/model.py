"""All relations of a scanned tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators import builds
from rookery.session import configured
from rookery.sources import java, settings
from rookery.sources.tree import BUILD_FILES, JAVA, config_files, scan_tree
from rookery.tables import settled


@dataclass
class RepoModel:
    classes: DataFrame
    properties: DataFrame
    dependencies: DataFrame
    findings: DataFrame
    build_files: DataFrame


def build_model(spark: SparkSession, root: str) -> RepoModel:
    """Scan a tree and derive its classes, properties, dependencies and findings. Each kind of file is read by a scan of its own."""
    configured(spark)
    classes = settled(java.resolved(settled(java.java_classes(scan_tree(spark, root, JAVA)), "parsed")), "classes")
    properties = settled(settings.config_properties(config_files(spark, root)), "properties")
    files = scan_tree(spark, root, BUILD_FILES)
    poms = settled(builds.poms(files.where("name = 'pom.xml' or lower(name) like '%.xml' and text like '%<project%'")), "poms")
    modules = builds.module_closure(poms).select("repo", "path")
    above = builds.parent_chains(poms.join(modules, ["repo", "path"], "left_semi")).select("repo", F.explode("chain").alias("path"))
    used = settled(modules.union(above).distinct(), "used-poms")
    maven = builds.resolved_dependencies(poms.join(used, ["repo", "path"], "left_semi"))
    scripts = files.where("path in ('build.gradle', 'build.gradle.kts')").join(poms.where("path = 'pom.xml'").select("repo"), "repo", "left_anti")
    first = scripts.groupBy("repo").agg(F.min_by(F.struct("path", "text"), "path").alias("f")).select("repo", "f.*")
    dependencies = settled(builds.first_of_each(maven.unionByName(builds.gradle_dependencies(first))), "dependencies")
    build_files = settled(used.union(first.select("repo", "path")), "build-files")
    return RepoModel(classes, properties, dependencies, builds.risk_findings(dependencies), build_files)
