"""Rule-based descriptions of code files, as one expression per sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

IMPORTS = "array<struct<source:string,type:string,line_imported:int>>"
FUNCTIONS = "array<struct<id:string,name:string,type:string,signature:string,line_start:int,line_end:int,description:string,exports:boolean,parameters:array<string>,return_type:string>>"
EXPORTED = "array<struct<name:string,type:string>>"


def _join(items: Column, most: int) -> Column:
    return S.join_list(items, most)


def _plural(items: Column, one: str, many: str) -> Column:
    n = F.size(items)
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), F.when(n > 1, many).otherwise(one)))


# The sentences below are what the map shows.
def file_description(files: DataFrame, *keep: str) -> DataFrame:
    """(file_id, keep, description). files: id, name, path, language, imports, exported, functions, content. Missing arrays count as empty, a missing content as empty. Contents are read whole."""
    f = files.select(
        F.col("id").alias("file_id"), *keep, "name", "path", "language",
        F.coalesce("imports", F.array().cast(IMPORTS)).alias("imports"),
        F.coalesce("functions", F.array().cast(FUNCTIONS)).alias("functions"),
        F.filter(F.coalesce(F.transform("exported", lambda e: e["name"]), F.array().cast("array<string>")), lambda n: n.isNotNull()).alias("exports"),
        F.coalesce("content", F.lit("")).alias("text"),
    )
    kind = lambda k: F.transform(F.filter("functions", lambda x: F.coalesce(x["type"] == k, F.lit(False))), lambda x: F.coalesce(x["name"], F.lit("")))
    source = lambda k: F.transform(F.filter("imports", lambda x: F.coalesce(x["type"] == k, F.lit(False))), lambda x: F.coalesce(x["source"], F.lit("")))
    f = f.select("*", *[kind(k).alias(c) for k, c in (("function", "fns"), ("class", "classes"), ("interface", "interfaces"), ("type", "types"), ("enum", "enums"), ("constant", "consts"))], source("package").alias("pkgs"), source("file").alias("locals"))
    lang, tick = S.lang_display(F.col("language")), lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    segs, n = F.split("path", "/"), lambda c: F.size(c)
    is_test = F.col("name").rlike(r"\.(test|spec)\.[tj]sx?$") | F.array_contains(segs, "__tests__")
    is_api = F.array_contains(segs, "api") & F.arrays_overlap(segs, F.array(*map(F.lit, ["pages", "app", "routes"])))
    is_react = F.coalesce(F.col("language").endswith("react"), F.lit(False)) | F.arrays_overlap(F.concat("pkgs", "locals"), F.array(F.lit("react"), F.lit("preact")))
    is_middle = F.exists("functions", lambda x: F.coalesce(x["signature"], F.lit("")).rlike(r"req[,\s].*res"))
    cases = F.when(n("exports") > 0, n("exports")).otherwise(n("fns"))
    named = F.filter("exports", lambda e: e != "default")
    names = F.filter(F.transform("functions", lambda x: x["name"]), lambda x: x.isNotNull())
    target = F.coalesce(F.get(named, F.lit(0)), F.get("fns", F.lit(0)), F.regexp_replace("name", r"\.[^.]+$", ""))
    component = F.concat(F.lit("Implements the "), S.ui_role(F.col("path"), F.col("name"), names), F.lit(" in "), tick(F.col("path")), F.lit(" through the "), tick(target), F.lit(" component."), F.when(n("locals") > 0, F.concat(F.lit(" It coordinates local modules such as "), _join(F.col("locals"), 4), F.lit("."))).otherwise(""))
    items = F.array_compact(F.array(_plural(F.col("classes"), "class", "classes"), _plural(F.col("interfaces"), "interface", "interfaces"), _plural(F.col("types"), "type", "types"), _plural(F.col("enums"), "enum", "enums"), _plural(F.col("fns"), "function", "functions"), _plural(F.col("consts"), "constant", "constants")))
    only_classes = (n("classes") > 0) & (n("fns") + n("interfaces") + n("types") + n("enums") == 0)
    first = (
        F.when(is_test, F.concat(lang, F.lit(" test file ("), "name", F.lit(")"), F.when(cases > 0, F.concat(F.lit(" covering "), cases.cast("string"), F.lit(" scenario"), F.when(cases > 1, "s").otherwise(""))).otherwise(""), F.lit(".")))
        .when(is_api, F.concat(lang, F.lit(" API route handler at "), "path", F.lit(".")))
        .when(is_react & (n("fns") + n("classes") > 0), component)
        .when(is_middle, F.concat(lang, F.lit(" middleware module exposing "), _join(F.when(n("fns") > 0, F.col("fns")).otherwise(F.col("exports")), 3), F.lit(".")))
        .when(only_classes, F.concat(lang, F.lit(" module exposing "), _join(F.col("classes"), 3), F.when(n("classes") == 1, " class.").otherwise(" classes.")))
        .when(n(items) > 0, F.concat(lang, F.lit(" module containing "), F.array_join(items, ", "), F.lit(".")))
        .otherwise(F.concat(lang, F.lit(" source file at "), tick(F.col("path")), F.lit(".")))
    )
    parts = F.array_compact(F.array(F.when(n("pkgs") > 0, F.concat(F.lit("packages "), _join(F.col("pkgs"), 4))), F.when(n("locals") > 0, F.concat(F.lit("local module"), F.when(n("locals") > 1, "s ").otherwise(" "), _join(F.col("locals"), 3)))))
    second = F.when(n(parts) > 0, F.concat(F.lit("Depends on "), F.array_join(parts, " and "), F.lit(".")))
    has_default = F.array_contains("exports", "default")
    third = (
        F.when((n("exports") > 0) & has_default & (n(named) > 0), F.concat(F.lit("Has a default export plus named exports "), _join(named, 4), F.lit(".")))
        .when((n("exports") > 0) & has_default, "Provides a single default export.")
        .when(n("exports") > 0, F.concat(F.lit("Exports "), _join(named, 4), F.lit(".")))
        .when(n("functions") > 0, "No symbols are exported from this module.")
    )
    signals = S.behavior_signals(F.col("path"), F.col("name"), names, F.concat("pkgs", "locals"), F.col("text"))
    fourth = F.when(n(signals) > 0, F.concat(F.lit("From the available code, it "), F.array_join(signals, ", "), F.lit(".")))
    shows = F.col("text").rlike(r"(?i)return\s*\(|<>|<div|<section|<main|<nav|<footer")
    fifth = F.when(is_react, F.when(shows, "Its main responsibility is rendering and coordinating the visible UI for this area of the application.")).when(
        F.lower("text").rlike("process|transform|validate|parse|map|build"), "Its main responsibility appears to be coordinating implementation logic rather than only declaring types or constants."
    )
    return f.select("file_id", *keep, F.concat_ws(" ", first, second, third, fourth, fifth).alias("description"))
