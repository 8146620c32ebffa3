"""N-gram Jaccard join with token-combination prefixes.

Tokens are the hashes of a document's distinct word shingles. Those that documents share form the frequent class, kept
as a table of bounded size (the most frequent ones); all others are rare. In the global order rare tokens come first
(by hash), then frequent ones by their count. A pair over the threshold shares all but ``e`` tokens of the smaller
prefix. Prefixes are a quarter longer than that needs, so a pair shares ``l = 1 + e // 4`` signatures at least, which
keeps apart documents that have a passage in common and no more:

- a document with enough rare tokens is indexed under its first ``e + l``, each alone;
- otherwise the prefix is extended: frequent tokens fall into classes by their hash, and each class is indexed under
  the combinations of two of its tokens. A class of ``b`` tokens makes up for ``b - 1`` of those needed. The number of
  classes follows the size of the set, so that combinations stay about in proportion to the prefix; sets near a
  power of two are indexed for both numbers.

A rare token in the prefix that is in no other prefix is missing from every document that has all its rare tokens in
its own. Where such tokens leave too few to share, pairs are ruled out before they are formed: a document that has too
many of them to be linked with any of the others gives up its combinations. So are pairs whose parity bitmaps (256 bits
of each set) differ in more bits than the threshold leaves tokens to differ.

Documents with equal sets form one class, named by the set's digest. Classes are compared in rounds: each signature's
group takes as leader the member with the smallest share of tokens of its own (for a group of near copies that is the
text they stem from), compares it with the members of other components, merges what is linked, and retires the leader.
Before each round a member leaves a group where the sizes and own tokens of the others rule all of them out, and a
group of one component is done, so that groups of near copies cost about as many comparisons as they have members.
What is still apart after ``rounds`` rounds is paired within its group, where sizes, own tokens and parity bitmaps rule
pairs out as they are formed, and the number of shared signatures does afterwards. Signatures that the same sets share
are one group, and a member looks for partners in its smallest groups only, as many as the number of signatures that a
pair must share leaves. No link is lost at any step: a bound only drops pairs that can't be linked. Comparisons use the
whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kumiki.llm.components import components
from kumiki.llm.kernel import FOLD, U, splitmix, texts_of, trimmed, window_hashes, windows_per_text, word_hashes, words
from kumiki.llm.shared import bounded, dropped, released, small_batches, without, without_repeats, written

#: The frequent class: tokens of at least so many documents by the blocks' reports, and no more of them than this.
FREQUENT_DOCS, FREQUENT_TOKENS = 4, 1 << 21
#: Tokens that are counted in one go, and the count below which a block doesn't report a token.
BLOCK_TOKENS, BLOCK_COUNT = 4_000_000, 2
#: A prefix is longer than needed by one part in so many of the tokens that a pair may lack.
SPARE = 4
#: Frequent tokens to a class, about.
CLASS_TOKENS = 4


def shingle_sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    for t in texts_of(column):
        w = words(t)
        h = word_hashes(t, w, FOLD)
        grams = window_hashes(h, k)
        n = windows_per_text(w, k)
        for i in range(len(t)):
            at = w.offs[i]
            if n[i]:
                yield np.unique(grams[at : at + n[i]])
            elif w.offs[i + 1] > at:
                short = h[at : w.offs[i + 1]]
                yield window_hashes(short, len(short))
            else:
                yield np.zeros(0, U)


def digest(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        one, two = splitmix(tokens).sum(dtype=U), splitmix(tokens ^ U(0x5DEECE66D1234567)).sum(dtype=U)
    return tuple(np.array([one, two], U).astype(np.int64).tolist())


def parities(tokens: np.ndarray) -> list[int]:
    """512 bits: whether an odd number of tokens falls to each. Two sets differ by as many tokens as bits, at least."""
    odd = np.bincount((splitmix(tokens ^ U(0x7F4A7C15DEADBEEF)) >> U(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


BITS = [f"b{i}" for i in range(8)]
SET_NAMES = ["id", "tx", "n", "hi", "lo", *BITS]


def set_rows(batches, k: int):
    """A row for each document (kind 0: size and digest of its set), and counts of tokens that recur (kind 1)."""
    block: list[np.ndarray] = []
    held = 0

    def counted():
        u, n = np.unique(np.concatenate(block), return_counts=True)
        u, n = u[n >= BLOCK_COUNT], n[n >= BLOCK_COUNT]
        none = pa.nulls(len(u), pa.int64())
        return pa.record_batch([none, none, pa.array(n, pa.int64()), pa.array(u.astype(np.int64)), *[none] * (1 + len(BITS))], SET_NAMES)

    for batch in batches:
        found: list[tuple] = []
        for tokens in shingle_sets(batch.column(1), k):
            found.append((len(tokens), *digest(tokens), *parities(tokens)))
            block.append(tokens)
            held += len(tokens)
            if held > BLOCK_TOKENS:
                yield counted()
                block, held = [], 0
        columns = zip(*found, strict=True) if found else [[]] * (3 + len(BITS))
        yield pa.record_batch([batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in columns)], SET_NAMES)
    if block:
        yield counted()


class Prefixes:
    """Signatures of sets, for a threshold in hundredths and a table of frequent tokens in ascending order of count."""

    def __init__(self, percent: int, frequent: np.ndarray):
        self.percent = percent
        order = np.argsort(frequent)
        self.known, self.rank = frequent[order], order.astype(np.int32)

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, bool]:
        """Signatures (the lowest bit is 1 for combinations), and whether all rare tokens are among them."""
        n, p = len(tokens), self.percent
        if not n or 100 * n // p == n:  # only an equal set can be linked
            return np.zeros(0, U), False
        lacking = n - (p * n + 99) // 100
        needed = lacking + 1 + lacking // SPARE
        at = np.minimum(np.searchsorted(self.known, tokens), max(0, len(self.known) - 1))
        frequent = self.known[at] == tokens if len(self.known) else np.zeros(n, bool)
        rare = tokens[~frequent][:needed]
        out = [splitmix(rare) & ~U(1)]
        if len(rare) < needed:
            common = tokens[frequent][np.argsort(self.rank[at[frequent]])]
            band = n.bit_length() - 1
            bands = [band] + [band - 1] * ((p * n + 99) // 100 < 1 << band)
            out += [self._pairs(common, needed - len(rare), b) for b in bands]
        return np.unique(np.concatenate(out)), len(rare) < needed

    def _pairs(self, common: np.ndarray, needed: int, band: int) -> np.ndarray:
        groups: dict[int, list[int]] = {}
        classes = max(1, (1 << band) * (100 - self.percent) // (100 * CLASS_TOKENS))
        kind = (splitmix(common) % U(classes)).tolist()
        out: list[tuple[int, int]] = []
        for token, c in zip(common.tolist(), kind, strict=True):
            if needed <= 0:
                break
            own = groups.setdefault(c, [])
            needed -= bool(own)
            out += [(other, token) for other in own]
            own.append(token)
        if not out:
            return np.zeros(0, U)
        pairs = np.sort(np.array(out, U), axis=1)
        with np.errstate(over="ignore"):
            return splitmix(pairs[:, 0] * U(0x9E3779B97F4A7C15) + splitmix(pairs[:, 1] + U(band + 1))) | U(1)


def signature_rows(batches, k: int, prefixes: Prefixes, odd: dict):
    """sig, id: the signatures of each set, under its name; and a row without sig that tells how many of them stand for
    one token and whether all rare tokens are among them. Of equal sets that a task meets, the first is enough."""
    met: set[int] = set()
    for batch in batches:
        names, sigs, size, full, single = [], [], [], [], []
        for tokens in shingle_sets(batch.column(1), k):
            name = name_of(tokens, odd)
            if name in met or not len(tokens):
                continue
            if len(met) < 200_000:
                met.add(name)
            own, whole = prefixes.of(tokens)
            names.append(name)
            sigs.append(own)
            size.append(len(own))
            full.append(whole)
            single.append(len(own) - int((own & U(1)).sum()))
        if names:
            n = sum(size)
            name = np.array(names, np.int64)
            sig = pa.concat_arrays([pa.array(np.concatenate(sigs).astype(np.int64)), pa.nulls(len(name), pa.int64())])
            cols = [
                sig,
                pa.array(np.concatenate([np.repeat(name, size), name])),
                pa.concat_arrays([pa.nulls(n, pa.bool_()), pa.array(full, pa.bool_())]),
                pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(single, pa.int32())]),
            ]
            yield pa.record_batch(cols, ["sig", "id", "whole", "singles"])


def name_of(tokens: np.ndarray, odd: dict) -> int:
    """The first half of the set's digest, or another number if a different set has that half, too."""
    hi, lo = digest(tokens)
    return odd.get((hi, lo), hi) if odd else hi


#: Bytes of sets that are handed on in one go.
SENT_BYTES = 8 << 20


def token_rows(batches, k: int, names: list[str]):
    """names, tokens for each of the rows of ids that a text is asked for (its second column)."""

    def sent(ids: list[dict], sets: list[bytes]) -> pa.RecordBatch:
        cols = [pa.array([x[n] for x in ids], pa.int64()) for n in names]
        return pa.record_batch([*cols, pa.array(sets, pa.binary())], [*names, "tokens"])

    for batch in batches:
        ids, sets, size = [], [], 0
        for tokens, asked in zip(shingle_sets(batch.column(0), k), batch.column(1).to_pylist(), strict=True):
            raw = tokens.tobytes()
            for pair in asked:
                ids.append(pair)
                sets.append(raw)
                size += len(raw)
                if size > SENT_BYTES:
                    yield sent(ids, sets)
                    ids, sets, size = [], [], 0
        yield sent(ids, sets)


def linked_rows(batches, percent: int):
    """a, b, both, linked of pairs of sets: the size of their intersection, and whether it is enough."""
    for batch in batches:
        both, ok = [], []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            n = len(np.intersect1d(x, y, assume_unique=True))
            both.append(n)
            ok.append(100 * n >= percent * (len(x) + len(y) - n))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(ok, pa.bool_())], ["a", "b", "both", "linked"])


def most_frequent(counts: DataFrame) -> np.ndarray:
    """The tokens of counts (hi, n) above the smallest count that leaves FREQUENT_TOKENS at most, in ascending order."""
    least, held = None, 0
    for n, many in sorted((r["m"], r["count"]) for r in counts.groupBy(F.least("n", F.lit(10_000)).alias("m")).count().collect())[::-1]:
        held += many
        if held > FREQUENT_TOKENS:
            break
        least = n
    if least is None:
        return np.zeros(0, U)
    top = counts.filter(F.col("n") >= least).toArrow()
    token, n = top["hi"].to_numpy().astype(U), top["n"].to_numpy()
    return token[np.lexsort((token, n))]


def named_sets(per_doc: DataFrame) -> tuple[DataFrame, dict]:
    """Classes of equal sets (id: their name, hi, lo, n, bits, first: id and tx of their smallest document), and the names of the sets
    whose first half of the digest is another set's as well: by chance about one of 2 ** 64 pairs of sets."""
    whole = per_doc.groupBy("hi", "lo", "n", *BITS).agg(F.min(F.struct("id", "tx")).alias("first"))
    whole = written(whole, "classes")
    twice = whole.groupBy("hi").agg(F.count(F.lit(1)).alias("c"), F.min("lo").alias("low")).filter("c > 1").select("hi", "low")
    found = whole.join(F.broadcast(twice), "hi").filter("lo <> low").select("hi", "lo", F.xxhash64("hi", "lo").alias("to")).collect()
    odd = {(r["hi"], r["lo"]): r["to"] for r in found}
    name = F.col("hi")
    for (hi, lo), to in odd.items():
        name = F.when((F.col("hi") == hi) & (F.col("lo") == lo), F.lit(to)).otherwise(name)
    return whole.withColumn("id", name), odd


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id reachable by links).

    Words are lower-cased (A-Z); a document of fewer than k words has its whole sequence as one shingle, one without
    words (or a null text) has none, is linked with nothing and is its own component. Ids are whole numbers; a row
    without an id is linked with nothing and has a null component_id. Rows that repeat an id and text give equal rows;
    rows that repeat an id with other texts are documents of their own, each in the component of its text. Other
    columns are not looked at. An empty table gives an empty result. how: as of row_components.
    """
    return row_components(docs, id_col, text_col, **how).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


def row_components(
    docs: DataFrame, id_col: str, text_col: str, k: int = 3, percent: int = 90, rounds: int = 2
) -> DataFrame:
    """id, tx (xxhash64 of the text), n (size of the set), group, component, a row for each row of docs.

    group names the component: an id that repeats with other texts may be the smallest of several.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tx"))
    rows = base.mapInArrow(lambda it: trimmed(set_rows(it, k)), ", ".join(f"{c} long" for c in SET_NAMES))
    # Rows of documents without an id have a null id too; counts of tokens carry a null lo.
    rows = written(rows, "sets")
    per_doc = rows.filter("lo IS NOT NULL")
    counts = rows.filter("lo IS NULL").groupBy("hi").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_DOCS)
    prefixes = spark.sparkContext.broadcast(Prefixes(percent, most_frequent(written(counts, "frequent"))))
    classes, odd = named_sets(per_doc.filter("id IS NOT NULL AND n > 0"))

    sigs = base.filter("id IS NOT NULL").mapInArrow(
        lambda it: trimmed(signature_rows(it, k, prefixes.value, odd)), "sig long, id long, whole boolean, singles int"
    )
    sigs = released(written(sigs, "signatures"))
    # What is told of a group is told to its members where they are: a window shuffles them once, on tables of any size.
    group = Window.partitionBy("sig")
    members = sigs.filter("sig IS NOT NULL").select("sig", "id", F.min("id").over(group).alias("x"), F.max("id").over(group).alias("y"))
    members = members.filter("x < y").select("sig", "id").distinct()
    # Signatures that the same sets share are one group of their weight, so that texts with much in common meet once. Groups
    # that get one name by chance are one group as well, in which more pairs may be compared.
    same = F.xxhash64(F.bit_xor(F.xxhash64("id")).over(group)).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("sig").bitwiseAND(F.lit(1)))
    members = members.select(same.alias("sig"), "id").groupBy("sig", "id").agg(F.count(F.lit(1)).cast("int").alias("weight"))
    members = released(written(members, "members"))

    # Tokens of a prefix that are in no other one.
    single = (F.col("sig").bitwiseAND(F.lit(1)) == 0).cast("int")
    held = sigs.filter("sig IS NULL").groupBy("id").agg(F.max("singles").alias("singles"), F.max("whole").alias("whole"))
    shared = members.groupBy("id").agg(F.sum(single * F.col("weight")).alias("shared"), F.sum("weight").alias("meets"))

    def spare_of(size):
        """Signatures beyond the first that a pair shares whose smaller set has this size."""
        return F.floor((size - F.floor((percent * size + 99) / 100)) / SPARE)

    sized = classes.select("id", F.col("n").cast("int").alias("n"), *BITS).join(shared, "id").join(held, "id")
    sized = sized.withColumn("dead", (F.col("singles") - F.col("shared")).cast("int"))
    # A set that shares fewer signatures with all others together than with a partner can't have one.
    sized = sized.filter(F.col("meets") > spare_of(F.ceil(percent * F.col("n") / 100))).drop("singles", "shared", "meets")
    sized = written(sized, "sizes")
    dropped(sigs)

    # The largest partner by the sizes, and where tokens of its own lack in the partner.
    n = F.col("n")
    reach = F.floor(100 * n / percent)
    top = F.least(reach, F.floor((n - F.col("dead")) * (100 + percent) / percent) - n)

    def bits(name: str) -> DataFrame:
        return sized.select(F.col("id").alias(name), F.col("n").alias(f"n{name}"), *(F.col(c).alias(c + name) for c in BITS))

    total = F.col("na") + F.col("nb")
    overlap = F.ceil(percent * total / (100 + percent))
    only_a = F.when(F.col("wholeb"), F.col("deada")).otherwise(0)
    only_b = F.when(F.col("wholea"), F.col("deadb")).otherwise(0)
    differ = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in BITS), F.lit(0))
    sizes_fit = (
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        & (F.col("na") - only_a >= overlap)
        & (F.col("nb") - only_b >= overlap)
    )
    bits_fit = differ <= total - 2 * overlap
    least = F.least("na", "nb")
    spare = spare_of(least)

    def sets_of(asked: DataFrame, name: str) -> DataFrame:
        """The columns of asked, with the set of the class that name holds, made from the text of its first document."""
        place = classes.select(F.col("id").alias(name), F.col("first.id").alias("id"), F.col("first.tx").alias("tx"))
        # One row for a document, with all that is asked of it, so that its set is made once.
        wanted = asked.join(place, name).groupBy("id", "tx").agg(F.collect_list(F.struct(*asked.columns)).alias("asked"))
        wanted = written(wanted, "asked")
        found = base.join(bounded(wanted), ["id", "tx"]).select("text", "asked")
        schema = ", ".join(f"{c} long" for c in asked.columns) + ", tokens binary"
        names = asked.columns
        return found.mapInArrow(lambda it: trimmed(token_rows(it, k, names)), schema)

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with the sizes of their intersections: the set of a is sent to that of b, which is sent once."""
        xs = sets_of(pairs.select("a", "b"), "a").withColumnRenamed("tokens", "x")
        ys = sets_of(pairs.select("b").distinct(), "b").withColumnRenamed("tokens", "y")
        both = xs.hint("merge").join(ys, "b").select("a", "b", "x", "y")
        out = both.mapInArrow(lambda it: trimmed(linked_rows(it, percent)), "a long, b long, both long, linked boolean")
        return released(written(out.distinct(), "links"))

    open_ = members.join(bounded(sized.drop(*BITS)), "id").withColumn("far", F.lit(None).cast("int"))
    columns = open_.columns
    done = labels = None
    before = members

    def labelled(part: DataFrame, name: str = "id", label: str = "label") -> DataFrame:
        """part with the component of each set so far; one that is linked with none is its own."""
        if labels is None:
            return part.withColumn(label, F.col(name))
        return part.join(labels.toDF(name, label), name, "left").withColumn(label, F.coalesce(label, name))

    def compared(pairs: DataFrame) -> None:
        """Compares pairs, and takes the links between components that are new into the labels."""
        nonlocal done, labels
        more = linked(pairs)
        done = more if done is None else done.unionByName(more)
        if labels is None or not more.filter("linked").isEmpty():
            labels = bounded(components(done.filter("linked")).select("node", "label"))

    for turn in range(rounds):
        named = labelled(open_)
        lead = F.min(F.struct((F.col("dead") / F.col("n")).alias("share"), "id", "n", "dead", "whole", "label")).over(group)
        told = {
            "x": F.min("label"), "y": F.max("label"), "low": F.min("n"), "all_whole": F.min("whole"),
            "far_top": F.max(top), "far_reach": F.max(reach),
        }
        left = named.withColumns({**{name: c.over(group) for name, c in told.items()}, "lead": lead}).filter("x <> y")
        left = left.withColumns({"center": F.col("lead.id"), "center_label": F.col("lead.label")})
        own = F.when(F.col("all_whole"), top).otherwise(reach)
        theirs = F.when(F.col("all_whole"), F.col("far_top")).otherwise(F.col("far_reach"))
        left = left.filter((own >= F.col("low")) & (theirs >= F.col("n")))
        if turn:  # the leader's component needs only those that can be linked with a member of another one
            alien = F.expr("label <> center_label")
            told = {"alien_low": F.min(F.when(alien, F.col("n"))), "alien_far": F.max(F.when(alien, own))}
            near = (own >= F.col("alien_low")) & (F.col("alien_far") >= F.col("n"))
            left = left.withColumns({name: c.over(group) for name, c in told.items()})
            left = left.filter(F.col("alien_low").isNotNull() & (near | alien))
        both = {"na": "n", "deada": "dead", "wholea": "whole", "nb": "lead.n", "deadb": "lead.dead", "wholeb": "lead.whole"}
        left = left.withColumns({name: F.col(c) for name, c in both.items()})
        left = left.withColumn("compare", F.expr("label <> center_label") & sizes_fit)
        left = released(written(left.select(*columns, "center", F.col("nb").alias("center_n"), "compare"), "open"))
        dropped(before)
        pairs = left.filter("compare").groupBy(F.col("id").alias("a"), F.col("center").alias("b")).agg(F.sum("weight").alias("shared"))
        pairs = pairs.join(bits("a"), "a").join(bits("b"), "b").filter(bits_fit).select("a", "b", "shared")
        pairs = written(pairs if done is None else pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        # First the leader that shares most signatures; the others only where they are still in other components.
        best = pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
        compared(best)
        rest = pairs.select("a", "b").join(done.select("a", "b"), ["a", "b"], "left_anti")
        rest = labelled(labelled(rest, "a", "la"), "b", "lb").filter("la <> lb").select("a", "b")
        compared(rest)
        dropped(pairs)
        stay = left.filter("id <> center")
        if not turn:  # how many tokens a member and its group's first leader differ by, where that has been counted
            measured = done.select(F.col("a").alias("id"), F.col("b").alias("center"), "both")
            stay = stay.join(bounded(measured), ["id", "center"], "left")
            stay = stay.withColumn("far", (F.col("n") + F.col("center_n") - 2 * F.col("both")).cast("int"))
        open_ = before = released(written(stay.select(columns), "open"))
        dropped(left)
    # What pairs of a group are still in different components and haven't been compared.
    open_ = labelled(open_.select("sig", "id", "weight", "far"))
    told = {"x": F.min("label"), "y": F.max("label"), "size": F.count(F.lit(1))}
    rest = open_.withColumns({name: c.over(group) for name, c in told.items()}).filter("x <> y").drop("x", "y")
    rest = released(written(rest, "rest"))
    dropped(before)
    # A pair shares so many signatures that its smallest group is not among the largest few of either member: in the order
    # of sizes each member looks for partners in the groups before those alone.
    fewest = spare_of(F.ceil(percent * F.col("n") / 100)) + 1
    by_size = Window.partitionBy("id").orderBy("size", "sig").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    told = {"ahead": F.sum("weight").over(by_size), "meets": F.sum("weight").over(Window.partitionBy("id"))}
    rest = rest.join(bounded(sized.drop(*BITS)), "id").withColumns(told).filter(F.col("meets") >= fewest)
    rest = written(rest.withColumn("first", F.col("ahead") >= fewest).drop("ahead", "meets", "size"), "rest")
    held = rest.groupBy("id").agg(F.collect_list(F.struct("sig", "weight")).alias("held"))
    heads = rest.filter("first").drop("first", "weight").join(sized.select("id", *BITS), "id")

    def half(name: str) -> DataFrame:
        return heads.select("sig", *(F.col(c).alias(f"{c}{name}" if c != "id" else name) for c in heads.columns if c != "sig"))

    # Of the tokens by which two sets differ from a third, those of their own can't be among what they share.
    apart = F.col("fara") + F.col("farb") - 2 * F.least(F.col("fara") - F.col("deada"), F.col("farb") - F.col("deadb"))
    close = ~(F.col("wholea") & F.col("wholeb")) | F.coalesce(apart <= total - 2 * overlap, F.lit(True))
    both = half("a").join(half("b"), "sig").filter((F.col("a") > F.col("b")) & (F.col("labela") != F.col("labelb")) & close & sizes_fit & bits_fit)
    crossing = written(both.select("a", "b", spare.alias("spare")).distinct(), "crossing")
    for name in "ab":
        crossing = crossing.join(held.toDF(name, f"held{name}"), name)
    shared = F.expr("aggregate(filter(helda, x -> array_contains(heldb.sig, x.sig)), 0L, (s, x) -> s + x.weight)")
    crossing = crossing.filter(shared > F.col("spare")).select("a", "b")
    known = done.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    crossing = written(crossing.join(known, ["a", "b"], "left_anti"), "crossing")
    more = None if crossing.isEmpty() else linked(crossing).filter("linked")
    if more is not None and not more.isEmpty():
        labels = components(done.filter("linked").unionByName(more)).select("node", "label")

    named = labelled(classes.select("id", "hi", "lo", "n", F.col("first.id").alias("first")), label="group")
    smallest = named.groupBy("group").agg(F.min("first").alias("component"))
    named = released(written(named.join(smallest, "group").select("hi", "lo", "n", "group", "component"), "components"))
    alone = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return per_doc.join(named, ["hi", "lo", "n"], "left").select("id", "tx", "n", "group", alone.alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id.

    Of rows with this id and other texts of the component one stays, and one of rows that repeat id and text. Rows
    without an id, a text or words are linked with nothing and stay. Columns of any name may be present. An empty
    table gives an empty result.
    """
    found = written(row_components(docs, id_col, text_col, **how).filter("id IS NOT NULL AND n > 0"), "row-components")
    stays = found.groupBy("group").agg(F.min(F.struct("id", "tx")).alias("one"), F.count(F.lit(1)).alias("rows"))
    stays = written(stays.filter("rows > 1").select("group", "one"), "stays")
    of_many = written(found.select("id", "tx", "group").join(stays, "group"), "near-copies")
    here = (F.col("id") == F.col("one.id")) & (F.col("tx") == F.col("one.tx"))
    left = without(docs, of_many.filter(~here).select("id", "tx"), id_col, text_col)
    twice = of_many.filter(here).groupBy("id", "tx").count().filter("count > 1").select("id", "tx")
    return without_repeats(left, twice, id_col, text_col)
