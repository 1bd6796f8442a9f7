"""Which Java a build asks for, from project files and a list of installed versions (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import text as T

#: Where plugins name a version, in the order in which the places are looked up.
COMPILER = (
    "configuration/release", "configuration/source", "configuration/target", "executions/execution/configuration/release",
    "executions/execution/configuration/source", "executions/execution/configuration/target", "configuration/jdkToolchain/version",
)
ENFORCER = ("executions/execution/configuration/rules/requireJavaVersion/version",)
PLUGINS = (("maven-compiler-plugin", COMPILER), ("maven-enforcer-plugin", ENFORCER))
#: The compiler plugins that decide alone, and the properties that count when no plugin names a version.
MAIN = tuple(f"/project/build/{place}plugin[artifactId='maven-compiler-plugin'][1]" for place in ("pluginManagement/plugins/", "plugins/"))
PROPERTIES = ("java.version", "version.java", "javaVersion", "jdk.version", "jre.version", "compiler.level", "maven.compiler.release", "maven.compiler.testRelease", "maven.compiler.source", "maven.compiler.target")
DEFAULT = "11"
#: Group and name of the plugins that a build is better run without.
UNNEEDED = (("org.codehaus.mojo", "findbugs-maven-plugin"), ("pl.project13.maven", "git-commit-id-plugin"), ("io.github.git-commit-id", "git-commit-id-maven-plugin"))


def without_namespaces(pom: Column) -> Column:
    """The document without namespaces, prefixes and head, so that paths are plain names."""
    plain = F.regexp_replace(pom, r"\sxmlns(:\w+)?=\"[^\"]*\"|\sxsi:\w+=\"[^\"]*\"|<\?xml[^>]*\?>", "")
    return F.regexp_replace(plain, r"(</?)\w+:(?=\w)", "$1")


def without_plugins(pom: Column, plugins: tuple[tuple[str, str], ...] = UNNEEDED) -> Column:
    """The document without the first element of each of ``plugins`` (group, name) and its equal copies; null stays null.

    An element counts if it opens with group and name in this order; another element of the same plugin that reads
    differently stays."""
    for group, name in plugins:
        first = F.regexp_extract(pom, rf"(?s)<plugin>\s*<groupId>\Q{group}\E</groupId>\s*<artifactId>\Q{name}\E</artifactId>.*?</plugin>", 0)
        pom = F.when(first == "", pom).otherwise(F.replace(pom, first, F.lit("")))
    return pom


def _value(raw: Column, properties: Column) -> Column:
    """A number as it stands, ``${name}`` looked up among the properties, the lower end of ``[a,b]``; else null."""
    name = F.regexp_extract(raw, r"\$\{(.+)\}", 1)
    looked = F.call_function("regexp_extract", properties, F.concat(F.lit(r"<\Q"), name, F.lit(r"\E>([^<]*)</")), F.lit(1))
    low = F.regexp_extract(raw, r"\[(.+),.*", 1)
    found = F.when(name != "", looked).when(T.is_number(raw), raw).otherwise(low)
    return F.when(T.is_number(found), T.strip(found))


#: Fixed value: stands between the results of several paths; no XML text can hold it.
_BETWEEN = "\x01"


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _firsts(plain: Column, paths: list[str]) -> Column:
    """The first text of each path, "" where there is none; the document is parsed once for all of them."""
    texts = ", ".join(f"{path}/text(), '{_BETWEEN}'" for path in paths)
    return F.split(F.xpath_string(plain, F.lit(f"concat({texts})")), _BETWEEN)


def detected_versions(pom: Column) -> Column:
    """Array of version texts: the first of the main compiler plugin; else all of any such plugin; else the properties'.

    A document is parsed once for each of the main plugins, then for the others, where it mentions such a plugin, and once for
    its properties, as long as no version was found."""
    none = F.array().cast("array<string>")
    # a name can hide behind entities, comments and the like, which need one of these marks
    named_in = lambda plain, plugin: F.contains(plain, F.lit(plugin)) | F.contains(plain, F.lit("&")) | F.contains(plain, F.lit("<!"))
    mention = lambda plain, plugin, texts: F.when(named_in(plain, plugin), texts).otherwise(none)
    filled = lambda xs: _once(xs, lambda ys: F.when(F.size(ys) > 0, ys))

    def found(doc: Column) -> Column:
        plain, properties = doc["plain"], doc["properties"]
        clean = lambda texts: F.array_compact(F.transform(texts, lambda x: _value(x, properties)))
        main = [clean(F.filter(mention(plain, PLUGINS[0][0], _firsts(plain, [f"{base}/{p}" for p in COMPILER])), lambda x: x != "")) for base in MAIN]
        anywhere = clean(F.concat(*[mention(plain, plugin, F.concat(*[F.xpath(plain, F.lit(f"//plugin[artifactId='{plugin}']/{p}/text()")) for p in ps])) for plugin, ps in PLUGINS]))
        named = F.filter(_firsts(plain, [f"/project/properties/*[name()='{p}']" for p in PROPERTIES]), T.is_number)
        return F.coalesce(*[filled(F.slice(m, 1, 1)) for m in main], filled(anywhere), F.transform(named, T.strip))

    doc = _once(without_namespaces(pom), lambda plain: F.struct(plain.alias("plain"), F.regexp_extract(plain, r"(?s)<properties>(.*?)</properties>", 1).alias("properties")))
    return _once(doc, found)


def greatest_version(pom: Column) -> Column:
    """The greatest version a project file asks for as a whole number; null without one."""
    return F.array_max(F.transform(detected_versions(pom), T.normal_version))


def java_homes(text: Column) -> Column:
    """Map of version to folder from a JSON object."""
    return F.from_json(text, "map<string,string>")


def chosen_home(version: Column, homes: Column) -> Column:
    """The home of the version itself, else of the smallest greater one, else of the default; null if there is none."""
    numbers = F.transform(F.map_keys(homes), lambda k: k.try_cast("int"))
    at_least = _once(version, lambda v: F.array_min(F.filter(numbers, lambda k: k >= v)))
    return F.coalesce(F.try_element_at(homes, at_least.cast("string")), F.try_element_at(homes, F.lit(DEFAULT)))


def with_home(poms: DataFrame, pom: str, homes: Column) -> DataFrame:
    """Adds ``java_version`` and ``java_home``."""
    version = greatest_version(F.col(pom))
    return poms.withColumn("java_version", version).withColumn("java_home", chosen_home(F.col("java_version"), homes))
