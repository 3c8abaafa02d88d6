"""Cross-checks between documents: traceability, field comparison, quotes, lineage. Each is a join with its leftovers kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import collapse, comparable, is_substantive, rollup_parent, squash
from quillon.functions.text import date_key


def traceability_matrix(parents: DataFrame, children: DataFrame, scope: str | None = None, separator: str | None = None) -> DataFrame:
    """upper_id, lower_ids, status of each parent id, then orphans. Needs id and ord, unique ids.

    linked: the id is on both sides; rolled_up: children whose id without its last segment is the parent's;
    out_of_scope: the pattern doesn't fit; missing: none of these. Children that nothing consumed are orphans.
    """
    p, c = parents.select("id", "ord"), children.select(F.col("id").alias("child"), F.col("ord").alias("child_ord"))
    linked = p.join(c, p["id"] == c["child"], "left")
    up = c.withColumn("up", rollup_parent(F.col("child"), separator) if separator else F.lit(None).cast("string"))
    rolled = up.where("up is not null").join(p.select(F.col("id").alias("up")), "up")
    groups = rolled.groupBy("up").agg(F.transform(F.array_sort(F.collect_list(F.struct("child_ord", "child"))), lambda s: s["child"]).alias("rolled"))
    rows = linked.join(groups, linked["id"] == groups["up"], "left")
    inside = F.col("id").rlike(scope) if scope else F.lit(True)
    status = F.when(F.col("child").isNotNull(), "linked").when(F.col("rolled").isNotNull(), "rolled_up").when(~inside, "out_of_scope").otherwise("missing")
    lower = F.when(F.col("child").isNotNull(), F.array("child")).otherwise(F.coalesce("rolled", F.array().cast("array<string>")))
    matrix = rows.select(F.col("id").alias("upper_id"), lower.alias("lower_ids"), status.alias("status"), "ord")
    # a child whose parent is there is consumed by it, whatever else the parent has
    orphans = c.join(p, c["child"] == p["id"], "left_anti").join(rolled.select("child"), "child", "left_anti")
    return matrix.unionByName(orphans.select(F.lit(None).cast("string").alias("upper_id"), F.array("child").alias("lower_ids"), F.lit("orphan").alias("status"), F.col("child_ord").alias("ord")))


def traceability(parents: DataFrame, children: DataFrame) -> DataFrame:
    """side, id, severity, unreviewed: ids that only one side has; where a side has none at all, one unreviewed row and nothing else."""
    n = parents.agg(F.count("*").alias("np")).crossJoin(children.agg(F.count("*").alias("nc")))  # one row
    gone = parents.join(children, "id", "left_anti").select(F.lit("parent").alias("side"), "id")
    new = children.join(parents, "id", "left_anti").select(F.lit("child").alias("side"), "id")
    rows = gone.unionByName(new).crossJoin(F.broadcast(n)).where("np > 0 and nc > 0").select("side", "id", F.lit("major").alias("severity"), F.lit(False).alias("unreviewed"))
    blind = n.where("np = 0 or nc = 0").select(F.lit("both").alias("side"), F.lit(None).cast("string").alias("id"), F.lit("info").alias("severity"), F.lit(True).alias("unreviewed"))
    return rows.unionByName(blind)


def compared_pair(rules: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """case_id, field, left_value, right_value, verdict (same, differs, unreviewed). rules: field, right_field; sides: case_id, field, value, found."""
    cases = left.select("case_id").unionByName(right.select("case_id")).distinct()
    grid = cases.crossJoin(F.broadcast(rules.withColumn("right_field", F.coalesce("right_field", "field"))))
    a = left.where("found").select("case_id", "field", F.col("value").alias("left_value"))
    b = right.where("found").select("case_id", F.col("field").alias("right_field"), F.col("value").alias("right_value"))
    rows = grid.join(a, ["case_id", "field"], "left").join(b, ["case_id", "right_field"], "left")
    verdict = F.when(F.col("left_value").isNull() | F.col("right_value").isNull(), "unreviewed").when(F.col("left_value") == F.col("right_value"), "same").otherwise("differs")
    return rows.select("case_id", "field", "left_value", "right_value", verdict.alias("verdict"))


def majority(values: DataFrame, expected: Column | None = None) -> DataFrame:
    """One row per case and field over its outputs (case_id, field, output_key, value, found): verdict and the outputs that are wrong.

    With one most frequent value the others are wrong; where several are as frequent all are. Disagreement counts for more
    than gaps; a gap without disagreement is unreviewed. A version in brackets doesn't count.
    """
    rows = values.withColumn("key", F.when(F.col("found"), comparable(F.col("value"))))
    per = rows.where("key is not null").groupBy("case_id", "field", "key").agg(F.count("*").alias("times"))
    top = per.groupBy("case_id", "field").agg(F.count("*").alias("n_values"), F.max("times").alias("most"), F.max_by("key", "times").alias("mode"))
    ties = per.join(top, ["case_id", "field"]).where("times = most").groupBy("case_id", "field").agg(F.count("*").alias("ties"))
    wide = rows.join(top, ["case_id", "field"], "left").join(ties, ["case_id", "field"], "left")
    wrong = F.col("key").isNotNull() & (F.col("n_values") > 1) & ((F.col("ties") > 1) | (F.col("key") != F.col("mode")))
    out = wide.groupBy("case_id", "field").agg(F.array_sort(F.collect_list(F.when(wrong, F.col("output_key")))).alias("wrong"), F.count_if(F.col("key").isNull()).alias("gaps"), F.max(F.coalesce("n_values", F.lit(0))).alias("n_values"))
    return out.select("case_id", "field", "wrong", "gaps", F.when(F.col("n_values") > 1, "differs").when(F.col("gaps") > 0, "unreviewed").otherwise("same").alias("verdict"))


def nondecreasing(values: DataFrame) -> DataFrame:
    """case_id, pos, output_key of dates that are earlier than the readable one before them, in rule order. Needs case_id, pos, output_key, value."""
    keyed = values.withColumn("key", date_key(F.col("value"))).where("key is not null")
    before = F.lag("key").over(Window.partitionBy("case_id").orderBy("pos"))
    return keyed.withColumn("before", before).where("key < before").select("case_id", "pos", "output_key", "key", "before")


def order_verdicts(values: DataFrame) -> DataFrame:
    """case_id, wrong (outputs whose date is before the readable one in front of them), unread, verdict. Needs case_id, pos, output_key, value.

    A date out of order counts for more than one that is missing or can't be read, which leaves the case unreviewed.
    """
    wrong = nondecreasing(values).groupBy("case_id").agg(F.array_sort(F.collect_list("output_key")).alias("wrong"))
    own = values.withColumn("key", date_key(F.col("value"))).groupBy("case_id").agg(F.count_if(F.col("key").isNull()).alias("unread"))
    out = own.join(wrong, "case_id", "left").withColumn("wrong", F.coalesce("wrong", F.array().cast("array<string>")))
    return out.select("case_id", "wrong", "unread", F.when(F.size("wrong") > 0, "differs").when(F.col("unread") > 0, "unreviewed").otherwise("same").alias("verdict"))


def abbreviations(used: DataFrame, listed: DataFrame, heads: DataFrame, ignore: list[str], lower: DataFrame) -> DataFrame:
    """doc_id, word, kind: unregistered (used but not listed) and unused (heads a line of the list but isn't used). All inputs: doc_id, word.

    Words that the document also spells in lower case are no abbreviations. A list of fewer than two entries is none:
    unregistered words are then not looked for, and a row says so.
    """
    short = heads.groupBy("doc_id").agg(F.count_distinct("word").alias("n")).where("n < 2").select("doc_id")
    known = heads.select("doc_id").distinct().join(short, "doc_id", "left_anti")
    new = used.select("doc_id", "word").distinct().join(known, "doc_id", "left_semi").where(~F.col("word").isin(ignore))
    new = new.join(listed, ["doc_id", "word"], "left_anti").join(lower, ["doc_id", "word"], "left_anti")
    old = heads.select("doc_id", "word").distinct().where(~F.col("word").isin(ignore)).join(used, ["doc_id", "word"], "left_anti")
    blind = short.select("doc_id", F.lit(None).cast("string").alias("word"), F.lit("unreviewed").alias("kind"))
    return new.withColumn("kind", F.lit("unregistered")).unionByName(old.withColumn("kind", F.lit("unused"))).unionByName(blind)


def references(parts: DataFrame, cited: DataFrame, section: str) -> DataFrame:
    """doc_id, number, kind: unknown (cited, but neither an entry nor a section) and unused (an entry that isn't cited).

    Entries are the numbered leaves under the section of that title; fewer than two: unreviewed. Needs doc_id, sec_id, title, and doc_id, number.
    """
    numbered = parts.where(F.col("sec_id").rlike(r"^\d")).select("doc_id", "sec_id", "title")
    root = numbered.where(collapse(F.col("title")) == section).groupBy("doc_id").agg(F.min("sec_id").alias("root"))
    under = numbered.join(root, "doc_id").where(F.col("sec_id").startswith(F.concat("root", F.lit("."))))
    holders = under.select("doc_id", F.regexp_replace("sec_id", r"\.[^.]*$", "").alias("sec_id")).distinct()
    entries = under.join(holders, ["doc_id", "sec_id"], "left_anti").select("doc_id", F.col("sec_id").alias("number"))
    n = root.join(entries.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fit = n.where("n >= 2").select("doc_id")
    cites = cited.select("doc_id", "number").distinct().join(fit, "doc_id", "left_semi")
    unknown = cites.join(entries, ["doc_id", "number"], "left_anti").join(numbered.select("doc_id", F.col("sec_id").alias("number")), ["doc_id", "number"], "left_anti")
    unused = entries.join(fit, "doc_id", "left_semi").join(cited, ["doc_id", "number"], "left_anti")
    blind = n.where("n < 2").select("doc_id", F.lit(None).cast("string").alias("number"), F.lit("unreviewed").alias("kind"))
    return unknown.withColumn("kind", F.lit("unknown")).unionByName(unused.withColumn("kind", F.lit("unused"))).unionByName(blind)


def verified_quotes(quotes: DataFrame, lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Quotes (doc_id, quote_id, quote) with where they stand: the first line, else the first section that holds them, white space aside; too short ones are skipped."""
    asked = quotes.where(is_substantive(F.col("quote"))).withColumn("q", collapse(F.col("quote")))
    by_line = asked.join(lines.select("doc_id", F.col("line_no"), collapse(F.col("line")).alias("l")), "doc_id").where(F.col("l").contains(F.col("q"))).groupBy("doc_id", "quote_id").agg(F.min("line_no").alias("line_no"))
    rest = asked.join(by_line, ["doc_id", "quote_id"], "left_anti")
    by_part = rest.join(parts.select("doc_id", "ord", collapse(F.col("text")).alias("t")), "doc_id").where(F.col("t").contains(F.col("q"))).groupBy("doc_id", "quote_id").agg(F.min("ord").alias("ord"))
    out = asked.join(by_line, ["doc_id", "quote_id"], "left").join(by_part, ["doc_id", "quote_id"], "left")
    return out.select("doc_id", "quote_id", "line_no", "ord", F.when(F.col("line_no").isNotNull(), "line").when(F.col("ord").isNotNull(), "section").otherwise("missing").alias("place"))


def closest_lines(quotes: DataFrame, lines: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, quote_id, line_no, score of the k lines that hold most of a quote's words (two characters or more); a line that holds all of the quote scores one more than them."""
    words = F.array_distinct(F.filter(F.split(collapse(F.col("quote")), " "), lambda w: F.char_length(w) >= 2))
    asked = quotes.select("doc_id", "quote_id", collapse(F.col("quote")).alias("q"), words.alias("words"))
    met = asked.join(lines.select("doc_id", "line_no", collapse(F.col("line")).alias("l")), "doc_id")
    score = F.when(F.col("l").contains(F.col("q")), F.size("words") + 1).otherwise(F.size(F.filter("words", lambda w: F.col("l").contains(w))))
    ranked = met.withColumn("score", score).where("score > 0").withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "quote_id").orderBy(F.desc("score"), "line_no")))
    return ranked.where(F.col("turn") <= k).select("doc_id", "quote_id", "line_no", "score", "turn")


def find_term(lines: DataFrame, term: str, most: int = 30) -> DataFrame:
    """The first ``most`` lines of each document that hold a term, case and all."""
    hits = lines.where(F.col("line").contains(term)).withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    return hits.where(F.col("turn") <= most).select("doc_id", "line_no", F.substring("line", 1, 2000).alias("line"))


def matched_findings(prior: DataFrame, new: DataFrame, blind: DataFrame) -> DataFrame:
    """Prior findings (id, checker, section, message, quotes) with status seen, not seen or cannot tell, and the new ones that match none.

    Equal checker and quote match, else a quote of 20 characters or more that the other holds; findings without quotes
    match by checker, section and message. A checker that is blind (checker) can't say that a finding is gone.
    """
    q = lambda t: t.select("id", "checker", F.explode("quotes").alias("quote")).withColumn("quote", squash(F.col("quote"))).where("quote <> ''")
    p, n = q(prior), q(new)
    exact = p.alias("p").join(n.alias("n"), (F.col("p.checker") == F.col("n.checker")) & (F.col("p.quote") == F.col("n.quote"))).select(F.col("p.id").alias("prior_id"), F.col("n.id").alias("new_id"))
    left_p = p.join(exact.select(F.col("prior_id").alias("id")), "id", "left_anti").alias("p")
    left_n = n.join(exact.select(F.col("new_id").alias("id")), "id", "left_anti").alias("n")
    shorter = F.least(F.length("p.quote"), F.length("n.quote"))
    near = left_p.join(left_n, (F.col("p.checker") == F.col("n.checker")) & (shorter >= 20) & (F.col("p.quote").contains(F.col("n.quote")) | F.col("n.quote").contains(F.col("p.quote")))).select(F.col("p.id").alias("prior_id"), F.col("n.id").alias("new_id"))
    bare = lambda t: t.where(F.size("quotes") <= 0).select("id", "checker", "section", "message")
    same = bare(prior).alias("p").join(bare(new).alias("n"), (F.col("p.checker") == F.col("n.checker")) & F.col("p.section").eqNullSafe(F.col("n.section")) & (F.col("p.message") == F.col("n.message"))).select(F.col("p.id").alias("prior_id"), F.col("n.id").alias("new_id"))
    pairs = exact.unionByName(near).unionByName(same)
    first = pairs.groupBy("prior_id").agg(F.min("new_id").alias("new_id"))
    old = prior.select(F.col("id").alias("prior_id"), "checker").join(first, "prior_id", "left").join(blind.select("checker").distinct().withColumn("is_blind", F.lit(True)), "checker", "left")
    status = F.when(F.col("new_id").isNotNull(), "seen").when(F.col("is_blind"), "cannot tell").otherwise("not seen")
    fresh = new.select(F.col("id").alias("new_id")).join(pairs.select("new_id"), "new_id", "left_anti")
    return old.select("prior_id", "new_id", status.alias("status")).unionByName(fresh.select(F.lit(None).cast("long").alias("prior_id"), "new_id", F.lit("new").alias("status")))


def carried_verdicts(new: DataFrame, verdicts: DataFrame) -> DataFrame:
    """New findings (id, key) with the verdict "not applicable" of an earlier finding, no other. verdicts: key, verdict.

    Keys that name quotes fit if checker and any one quote are the same; others only as a whole. Null keys carry nothing.
    """
    parts = F.split("key", "\u001f")
    quoted = F.when(F.startswith("key", F.lit("q\u001f")), F.transform(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), lambda q: F.concat_ws("\u001f", F.get(parts, 1), q)))
    shares = F.explode(F.when(quoted.isNull(), F.array("key")).otherwise(F.filter(quoted, lambda q: ~q.endswith("\u001f"))))
    kept = verdicts.where("verdict = 'not applicable' AND key IS NOT NULL").select(shares.alias("share")).distinct()
    carried = new.select("id", shares.alias("share")).join(kept, "share", "left_semi").select("id").distinct().withColumn("verdict", F.lit("not applicable"))
    return new.join(carried, "id", "left").select("id", "key", "verdict")


def prior_entry(names: DataFrame, history: DataFrame) -> DataFrame:
    """The newest history entry (entry_id, title) whose title, without its extension, is or holds each name (name_id, name); an empty or null name has none."""
    titles = history.select("entry_id", F.regexp_replace("title", r"\.[^.]+$", "").alias("title"))
    met = names.join(titles, F.col("title").contains(F.col("name")) & (F.col("name") != ""), "left")
    return met.groupBy("name_id", "name").agg(F.max("entry_id").alias("entry_id"))


def manual_review(rules: DataFrame, given: DataFrame, fields: DataFrame) -> DataFrame:
    """item, status: given values (item, value) against every extracted value of the item's field (rules: item, field; fields: field, value, found).

    Values are counted for each field and key, so that no item meets every value of its field.
    """
    key = lambda c: F.coalesce(date_key(F.col(c)), squash(F.col(c)))
    met = fields.where("found").groupBy("field", key("value").alias("key")).agg(F.count("*").alias("n"))
    total = met.groupBy("field").agg(F.sum("n").alias("n_found"), F.sum(F.when(F.col("key").isNotNull(), F.col("n"))).alias("n_keyed"))
    rows = rules.join(given.select("item", F.col("value").alias("given")), "item", "left").withColumn("key", key("given"))
    rows = rows.join(total, "field", "left").join(met.withColumnRenamed("n", "n_same"), ["field", "key"], "left")
    differ = F.when(F.col("key").isNotNull(), F.col("n_keyed") - F.coalesce("n_same", F.lit(0)))
    out = rows.groupBy("item").agg(F.max("given").alias("given"), F.coalesce(F.sum("n_found"), F.lit(0)).alias("n_found"), F.sum(differ).alias("n_differ"))
    return out.select("item", F.when(F.col("given").isNull(), "manual").when(F.col("n_found") == 0, "unreviewed").when(F.col("n_differ") > 0, "flagged").otherwise("clean").alias("status"))


def attributed(criteria: DataFrame, findings: DataFrame) -> DataFrame:
    """Criteria (no, mode, rule_id, checker_key) with their findings: a model's by rule id, rules' by checker."""
    by_rule = criteria.where("mode = 'model'").join(findings.select(F.col("rule_id"), "finding_id", "unreviewed"), "rule_id", "left")
    by_key = criteria.where("mode <> 'model'").join(findings.select(F.col("checker").alias("checker_key"), "finding_id", "unreviewed"), "checker_key", "left")
    columns = ["no", "mode", "rule_id", "checker_key", "finding_id", "unreviewed"]
    return by_rule.select(*columns).unionByName(by_key.select(*columns))


def fields_by_name(outputs: DataFrame, rules: DataFrame) -> DataFrame:
    """field, outputs (sorted), rules (sorted), of fields that either side names. Needs field, output_key, and field, rule."""
    a = outputs.groupBy("field").agg(F.array_sort(F.collect_set("output_key")).alias("outputs"))
    b = rules.groupBy("field").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    none = F.array().cast("array<string>")
    return a.join(b, "field", "full").select("field", F.coalesce("outputs", none).alias("outputs"), F.coalesce("rules", none).alias("rules"))


def detected(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, team, n_ids, best: distinct ids of each team's pattern in each document; best where the most, above 0. Needs doc_id, text, and team, pattern."""
    met = texts.crossJoin(F.broadcast(patterns)).select("doc_id", "team", F.size(F.array_distinct(F.expr("regexp_extract_all(text, pattern, 0)"))).alias("n_ids"))  # patterns are a short list
    most = F.max("n_ids").over(Window.partitionBy("doc_id"))
    return met.withColumn("best", (most > 0) & (F.col("n_ids") == most))
