"""Line dedup by a log-template tree.

A line falls through a tree of fixed depth: its number of tokens, then its leading tokens, with tokens that hold a digit as
variables. In a leaf, lines that agree with the leaf's consensus (the most frequent token of each position) in most
positions are one template, in which the positions that differ are variables; what does not agree goes through a second consensus, and
what agrees with neither goes on with the leaf's most frequent open line, until no leaf has lines left that could be a template together.
That is done for many lines at once: of a leaf's most frequent open lines, those that agree with none before them lead a template each, and a
line belongs to the first leader that it agrees with. Lines of templates that recur across documents are dropped, but for those of the template's first document, so that a
text that was copied as a whole survives once.

Only hashes of lines are shuffled. Tokens are needed in leaves with several variants; one text for each variant is read again, which a
Bloom filter picks in the scan, as another does with its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from knownthen.llm.hot import dealt_join
from knownthen.llm.url_filter import BITS_PER_KEY, MAX_BLOCKS, block_of, bloom_words, mask_of
from knownthen.sources.shared import written

#: Depth of the tree below the token count; shorter lines are kept as they are.
DEPTH = 3
#: Documents in which a template must occur to be dropped, and share of positions that must agree with a consensus, in percent.
MIN_DOCS, AGREE_PCT = 4, 70
#: Consensus rounds; in those after them a leaf's most frequent open lines stand for the consensus.
ROUNDS = 2
#: Open lines, and tokens of them, among which a round seeks a leaf's leaders; lines of a leaf that a task compares with them, about.
LEADERS, TOKENS, DEALT = 512, 1 << 16, 4096
VARIABLE = "<*>"
SPACE = r"[\x20\x09-\x0D]+"


def _plain(line: Column) -> Column:
    """A line's tokens joined by single spaces."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | F.contains(line, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.regexp_replace(F.regexp_replace(line, SPACE, " "), "^ | $", "")).otherwise(line)


def _masked(plain: Column) -> Column:
    """The same with tokens that hold a digit as variables."""
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "[^ ]*[0-9][^ ]*", VARIABLE)).otherwise(plain)


def _lines(docs: DataFrame, text: str, line: bool = False) -> DataFrame:
    """doc_id, print (hash of the text), pos, leaf, variant of the lines that are parsed, and the masked `line` if asked for. Nested transforms compute each step once for a line."""
    lines = F.transform(F.transform(F.split(text, "\n", -1), _plain), _masked)
    spaces = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    lines = F.transform(lines, lambda x, i: F.struct(
        i.alias("pos"), x.alias("line"), (spaces(x) + 1).alias("n"), F.xxhash64(x).alias("variant")))
    lines = F.filter(lines, lambda x: x["n"] >= DEPTH)
    lines = F.transform(lines, lambda x: F.struct(
        x["pos"].alias("pos"), x["variant"].alias("variant"), F.xxhash64(x["n"], F.substring_index(x["line"], " ", DEPTH)).alias("leaf"),
        *([x["line"].alias("line")] if line else [])))
    return docs.select("doc_id", F.xxhash64(text).alias("print"), F.explode(lines).alias("_l")).select("doc_id", "print", "_l.*")


def _maybe(keys: DataFrame, count: int, key: Column) -> Column:
    """Whether `key` may be one of the `count` keys in the first column. The filter is one value in the condition, never a column of the rows."""
    blocks = 1
    while blocks * 64 < count * BITS_PER_KEY and blocks < MAX_BLOCKS:
        blocks *= 2
    words = bloom_words(keys.toDF("key"), blocks).scalar()
    return F.element_at(words, block_of(key, blocks) + 1).bitwiseAND(mask_of(key)) == mask_of(key)


def _agree(tokens: Column, best: Column) -> Column:
    same = F.size(F.filter(F.zip_with(tokens, best, lambda x, y: x == y), lambda x: x))
    return same * 100 >= F.size(tokens) * AGREE_PCT


def _consensus(open_: DataFrame) -> DataFrame:
    """leaf, best: the most frequent token of each position."""
    token = open_.select("leaf", "docs", F.posexplode("tokens").alias("at", "token"))
    votes = token.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("votes"))
    best = votes.groupBy("leaf", "at").agg(F.max(F.struct("votes", "token")).alias("best"))
    consensus = best.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", F.col("best.token").alias("token")))).alias("best"))
    return consensus.select("leaf", F.transform("best", lambda x: x["token"]).alias("best"))


def _leaders(open_: DataFrame) -> DataFrame:
    """leaf, k, leaders: of its k lines the most frequent ones that agree with none before them, in order."""
    order = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("docs"), F.desc("tokens")))
    head = open_.withColumn("rank", order).filter(F.col("rank") <= LEADERS).filter((F.col("rank") == 1) | (F.col("rank") * F.size("tokens") <= TOKENS))
    head = head.groupBy("leaf").agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("rank", "tokens"))).alias("head"))
    none = F.array().cast("array<array<string>>")
    return head.select("leaf", "k", F.aggregate(F.transform("head", lambda x: x["tokens"]), none, lambda led, x: F.when(
        F.exists(led, lambda y: _agree(x, y)), led).otherwise(F.concat(led, F.array(x)))).alias("leaders"))


def _templates(docs: DataFrame, variants: DataFrame, text: str) -> DataFrame:
    """variant, template for the variants that share a template with others; variants: leaf, variant, docs, print."""
    variants = written(variants, "variants")
    crowded = (variants.groupBy("leaf").agg(F.count("*").alias("k"), F.sum("docs").alias("d"))
               .filter((F.col("k") > 1) & (F.col("d") >= MIN_DOCS)).select("leaf"))
    asked = written(variants.join(crowded, "leaf"), "crowded")
    count = asked.count()
    # a hash that comes out of an explode is computed once, not for each place where the filter needs it
    hashed = docs.select("doc_id", text, F.explode(F.array(F.xxhash64(text))).alias("print"))
    texts = hashed.filter(_maybe(asked.select("print"), count, F.col("print"))).select("doc_id", text)
    lines = _lines(texts, text, line=True).filter(_maybe(asked.select("variant"), count, F.col("variant"))).select("variant", "line")
    open_ = written(asked.join(lines.groupBy("variant").agg(F.first("line").alias("line")), "variant")
                    .select("leaf", "variant", "docs", F.split("line", " ", -1).alias("tokens")), "open")
    found = None
    for number in range(ROUNDS):
        fits = written(open_.join(_consensus(open_), "leaf").select(
            "leaf", "variant", "docs", "tokens", _agree(F.col("tokens"), F.col("best")).alias("fits")), "fits")
        own = fits.filter("fits").select("variant", F.xxhash64("leaf", F.lit(number)).alias("template"))
        found = own if found is None else found.union(own)
        open_ = fits.filter("not fits").drop("fits")
    number = ROUNDS
    while True:  # a single line is counted as it is, and lines of fewer documents are no template
        live = open_.groupBy("leaf").agg(F.count("*").alias("k"), F.sum("docs").alias("d")).filter((F.col("k") > 1) & (F.col("d") >= MIN_DOCS))
        open_ = written(open_.join(live.select("leaf", "k"), "leaf"), "open")
        if open_.isEmpty():
            return found
        # the first leader that a line agrees with, or 0
        numbered = F.transform("leaders", lambda x, i: F.struct((i + 1).alias("at"), x.alias("tokens")))
        first = F.aggregate(numbered, F.lit(0), lambda at, x: F.when(at > 0, at).when(_agree(F.col("tokens"), x["tokens"]), x["at"]).otherwise(0))
        fits = written(dealt_join(open_.drop("k"), _leaders(open_), "leaf", "k", F.col("variant"), DEALT).select(
            "leaf", "variant", "docs", "tokens", first.alias("at")), "fits")
        found = found.union(fits.filter("at > 0").select("variant", F.xxhash64("leaf", F.lit(number), "at").alias("template")))
        open_ = fits.filter("at = 0").drop("at")
        number += 1


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with recurring lines dropped from the text, and n_lines and n_dropped.

    Lines are pieces between \\n, of at least three tokens; others always stay. A null text stays null with no lines. Documents
    are told apart by doc_id: rows that share one are one document, and rows without one are one document that is nobody's first. Repeated rows
    are cleaned alike. A text all of whose lines go becomes empty. Columns named like the new ones are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*keep)
    source = docs.select("doc_id", text).filter(F.col(text).isNotNull())
    parsed = written(_lines(source, text).select("doc_id", "print", "pos", "leaf", "variant"), "parsed")
    seen = written(parsed.groupBy("leaf", "variant", "doc_id").agg(F.min("print").alias("print")), "seen")
    shared = written(_templates(source, seen.groupBy("leaf", "variant").agg(F.count("*").alias("docs"), F.min("print").alias("print")), text), "templates")
    # a document counts once for a template, whatever its variants
    several = seen.join(shared, "variant").select("template", "doc_id").distinct().groupBy("template").agg(
        F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    merged = shared.join(several, "template").select("variant", "docs", "first")
    single = (seen.groupBy("variant").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).filter(F.col("docs") >= MIN_DOCS)
              .join(shared, "variant", "left_anti"))
    recurring = merged.filter(F.col("docs") >= MIN_DOCS).union(single.select("variant", "docs", "first")).drop("docs")
    dropped = parsed.join(recurring, "variant").filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    # the hash of the text keeps rows apart that share a doc_id; repeated rows have the same positions
    places = dropped.groupBy("doc_id", "print").agg(F.collect_set("pos").alias("_pos")).withColumnsRenamed({"doc_id": "_id", "print": "_print"})
    at = docs.join(places, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text]) == F.col("_print")), "left")
    # lines are bound once for a text: an expression in a transform is computed for each of its elements
    lines = F.split(text, "\n", -1)
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_pos"))
    at = at.withColumn("_text", F.when(F.col("_pos").isNull(), F.col(text)).otherwise(F.get(F.transform(
        F.array(lines), lambda x: F.array_join(F.transform(left(x), lambda i: F.get(x, i)), "\n")), F.lit(0))))
    return at.select(*[F.col("_text").alias(text) if c == text else F.col(c) for c in keep],
                     F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                     F.coalesce(F.size("_pos"), F.lit(0)).cast("long").alias("n_dropped"))
