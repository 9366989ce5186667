"""Discovery: call shapes whose string arguments are mostly paths become rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import fixed
from emberline.functions.text import escaped, literal_class, posterior

CALL = r"(@)?((?:[A-Za-z_$][\w$]*\.)+)?([A-Za-z_$][\w$]*)\s*\(([^()]*)\)"
STRING = r"[rbfuRBFU]{0,3}([\"'`])((?:\\.|(?!\1)[^\\])*)\1"


def call_arguments(lines: DataFrame) -> DataFrame:
    """file, lang, shape, callee, arg, text: the first string of each argument of each call on a line. lines: file, lang, line."""
    call = lambda g: F.expr(f"regexp_extract_all(line, r'{CALL}', {g})")
    x = lines.where(F.contains("line", F.lit("(")) & F.col("line").rlike("[\"'`]")).select("file", "lang", F.explode(F.arrays_zip(call(1).alias("at"), call(2).alias("recv"), call(3).alias("callee"), call(4).alias("args"))).alias("c"))
    x = x.where(~F.col("c.callee").isin(*fixed.DISCOVERY_DENIED) & (F.col("c.args") != ""))
    shape = F.when(F.col("c.at") == "@", "dec").when(F.col("c.recv") != "", "recv").otherwise("bare")
    x = x.select("file", "lang", shape.alias("shape"), F.col("c.callee").alias("callee"), F.posexplode(F.split("c.args", ",")).alias("arg", "raw"))
    return x.withColumn("text", F.regexp_extract("raw", STRING, 2)).where("text <> ''").select("file", "lang", "shape", "callee", "arg", "text")


def histogram(args: DataFrame) -> DataFrame:
    """lang, shape, callee, arg, n, path_n, files."""
    is_path = (F.coalesce(literal_class(F.col("text")), F.lit("")) == "path").cast("int")
    return args.groupBy("lang", "shape", "callee", "arg").agg(F.count("*").alias("n"), F.sum(is_path).alias("path_n"), F.countDistinct("file").alias("files"))


def covered(sigs: DataFrame, rules: DataFrame) -> DataFrame:
    """Signatures without those that a rule binds already. rules: lang, methods, pattern; there are few rules."""
    r = F.broadcast(rules.select(F.col("lang").alias("r_lang"), F.col("methods").alias("r_methods"), F.col("pattern").alias("r_pattern")))
    fits = F.when(F.col("shape") == "recv", F.col("r_pattern").rlike(r"^\$R\.\$M\(")).when(F.col("shape") == "bare", F.col("r_pattern").rlike(r"^\$M[(\s]")).otherwise(F.col("r_pattern").rlike(r"^@\$(R\.)?M\("))
    return sigs.join(r, (F.col("lang") == F.col("r_lang")) & fits & F.expr("callee rlike r_methods"), "left_anti")


def promoted(sigs: DataFrame) -> DataFrame:
    """id, lang, methods, patterns, n, path_n, files, posterior of signatures that clear the floors."""
    p = posterior(F.col("path_n"), F.col("n"))
    x = sigs.where((F.col("n") >= fixed.MIN_SITES) & (F.col("files") >= fixed.MIN_SIG_FILES) & (p >= fixed.MIN_POSTERIOR))
    slots = F.array_join(F.transform(F.sequence(F.lit(0), F.col("arg")), lambda i: F.when(i == F.col("arg"), F.lit("$P")).otherwise(F.concat(F.lit("$X"), i.cast("string")))), ", ")
    head = F.when(F.col("shape") == "recv", "$R.$M(").when(F.col("shape") == "bare", "$M(").otherwise("@$M(")
    return x.select(
        F.concat_ws(":", F.lit("implicit"), F.lower("lang"), "shape", "callee", F.col("arg").cast("string")).alias("id"), "lang",
        F.concat(F.lit("^(?i:"), escaped(F.col("callee")), F.lit(")$")).alias("methods"),
        F.array(F.concat(head, slots, F.lit(")")), F.concat(head, slots, F.lit(", $$$H)"))).alias("patterns"), "n", "path_n", "files", p.alias("posterior"),
    )
