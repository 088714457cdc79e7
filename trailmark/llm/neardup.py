"""Near-duplicate classes by ProbMinHash signatures, banding and verification.

A text is the bag of its runs of five words; the weight of a run is how often
it occurs.  Every element of the bag is a Poisson process with its weight as
rate: its arrivals are drawn from a hash of the element, each falls into a
random slot of the signature, and a slot keeps the element that came first.
Elements stop as soon as their next arrival is later than the last slot.  Two
texts agree in a slot with the probability of their probability Jaccard
similarity, whatever their lengths.  With weights of one it is the plain Jaccard
similarity; texts that repeat a run of words have such a signature as well, and
for all others the two are the same.

Texts that agree in all slots of a band meet in a bucket.  All members of a
bucket are compared with one pivot first.  Those that end up outside the
pivot's class are then compared with all others: in small buckets as pairs, and
in larger ones, of which those with one pivot are taken together, in blocks of
texts, each of which yields just the links that connect its classes.  So no link
that the bands show is lost, and thousands of copies of one text make few rows.
Every link is exact, from the texts; pairs whose signatures are far apart are
not looked at further.

A bucket, a pivot, a class or the copies of one text may hold a third of all
rows.  Keys that hold more than a ten-thousandth are found by counts that are
combined before they are shuffled, and their rows are not dealt by the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.bytewords import _BASE, Words, blocks, grams, mix
from trailmark.llm.common import HOT_ROWS, cut, cut_small, fresh, hot_bound, join_counted, join_hot, table
from trailmark.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
#: Members up to which the outsiders of a bucket are compared with all of it at once.
SMALL_BUCKET = 32
#: Texts and their bytes on either side of a block in which larger groups are compared, and shingles that it looks at together.
BLOCK, BLOCK_BYTES, BLOCK_COLUMNS = 256, 1 << 22, 8192
#: Pairs are compared exactly if their signatures agree this much less than the threshold; five deviations at 160 slots.
SLACK = 0.16
#: Nodes (32 bytes each) up to which a list of them is broadcast; beyond, texts are joined with it by their keys.
BROADCAST_NODES = 250_000
#: Tasks that the text of a node is sent to if many pairs have it.
SALTS = 64
_NULL_DOC = -(1 << 63)
_U = np.uint64


def bags(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, count) of the shingles of a block of texts, by text and element.

    A text of fewer words than ``k`` has one element, all its words; one without words has none.
    """
    hashes, at = grams(words, k)
    doc = words.doc[at]
    count = np.diff(words.first)
    for n in range(1, k):
        if (count == n).any():
            h, a = grams(words, n)
            own = count[words.doc[a]] == n
            hashes, doc = np.concatenate([hashes, h[own]]), np.concatenate([doc, words.doc[a[own]]])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """(n_docs, slots) elements that arrive first; texts without elements get zeros."""
    first = np.full(n_docs * slots, np.inf)
    who = np.zeros(n_docs * slots, np.uint64)
    time, drawn = np.zeros(len(doc)), np.zeros(len(doc), np.int64)
    live = np.arange(len(doc))
    while len(live):
        alive = np.bincount(doc[live], minlength=n_docs)
        # few elements draw many arrivals at once, many elements one each
        steps = np.maximum(1, (2 * slots) // np.maximum(alive, 1))[doc[live]]
        e = np.repeat(live, steps)
        begin = np.cumsum(steps) - steps
        turn = np.arange(len(e)) - np.repeat(begin, steps) + drawn[e]
        bits = mix(element[e] + (turn.astype(np.uint64) + _U(1)) * _BASE)
        gap = -np.log(((bits >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight[e]
        total = np.cumsum(gap)
        at = total - np.repeat(total[begin] - gap[begin], steps) + time[e]
        slot = doc[e] * slots + (mix(bits ^ _U(0xA5A5A5A5)) % _U(slots)).astype(np.int64)
        sooner = np.flatnonzero(at < first[slot])
        np.minimum.at(first, slot[sooner], at[sooner])
        won = sooner[at[sooner] == first[slot[sooner]]]
        who[slot[won]] = element[e[won]]
        time[live] = at[begin + steps - 1]
        drawn[live] += steps
        latest = first.reshape(n_docs, slots).max(axis=1)
        live = live[time[live] < latest[doc[live]]]
    return who.reshape(n_docs, slots)


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) buckets of signatures."""
    band = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        band = mix(band * _BASE + sig.reshape(len(sig), bands, rows)[:, :, r])
    return mix(band + np.arange(bands, dtype=np.uint64) * _BASE).view(np.int64)


def _signer(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in blocks(batch.column(3)):
                words = Words(data, off)
                doc, element, count = bags(words, shingle)
                sig = signatures(doc, element, count.astype(np.float64), j - i, bands * rows)
                # texts that repeat an element, and their signatures with all weights one
                twice = np.flatnonzero(np.bincount(doc, weights=count > 1, minlength=j - i) > 0)
                own = np.isin(doc, twice)
                flat = signatures(np.searchsorted(twice, doc[own]), element[own], np.ones(own.sum()), len(twice), bands * rows)
                band = np.tile(_band_keys(sig, bands, rows), (1, 2))
                band[twice, bands:] = _band_keys(flat, bands, rows)
                use = np.repeat((np.bincount(doc, minlength=j - i) > 0)[:, None], 2 * bands, axis=1)
                use[:, bands:] &= band[:, :bands] != band[:, bands:]
                sketch = [x.tobytes() for x in (sig & _U(0xFF)).astype(np.uint8)]
                for t, x in zip(twice, (flat & _U(0xFF)).astype(np.uint8), strict=True):
                    sketch[t] += x.tobytes()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(use.sum(axis=1))]).astype(np.int32)), pa.array(band[use]))
                yield pa.record_batch([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(np.diff(off)), lists, pa.array(sketch, pa.binary())], names=["doc", "k1", "k2", "n_bytes", "bands", "sketch"])

    return run


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard and plain Jaccard of two bags (elements in order, counts)."""
    both, a, b = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    union = len(x[0]) + len(y[0]) - len(both)
    if not len(both):
        return 0.0, 0.0
    plain = len(both) / union
    p, q = x[1][a].astype(np.float64), y[1][b].astype(np.float64)
    ratio = p / q
    order = np.argsort(ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    # of each shared element: the share of x that weighs at least as much there, and the rest of y
    only_x, only_y = x[1].sum() - p.sum(), y[1].sum() - q.sum()
    from_x = np.concatenate([[0], np.cumsum(p[::-1])])[::-1]
    from_y = np.concatenate([[0], np.cumsum(q)])
    at = np.searchsorted(ratio, ratio, side="left")
    terms = (only_x + from_x[at]) / p + (only_y + from_y[at]) / q
    return float((1 / terms).sum()), plain


def _bag_list(column: pa.Array, shingle: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for p, q, data, off in blocks(column):
        doc, element, count = bags(Words(data, off), shingle)
        cuts = np.searchsorted(doc, np.arange(q - p + 1))
        out += [(element[s:e], count[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def _verifier(shingle: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column("text_a"), batch.column("text_b")]
            keep = []
            for i in range(0, batch.num_rows, 64):
                j = min(batch.num_rows, i + 64)
                keep += [max(similarity(x, y)) >= threshold for x, y in zip(*(_bag_list(t.slice(i, j - i), shingle) for t in texts), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def _sifter(slots: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            both = [batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b")]
            # by weights and by weights of one, where a text has a second sketch
            equal = np.zeros(batch.num_rows)
            for part in (lambda s: s[:slots], lambda s: s[-slots:]):
                x, y = (np.frombuffer(b"".join(map(part, side)), np.uint8).reshape(-1, slots) for side in both)
                equal = np.maximum(equal, (x == y).mean(axis=1))
            # bytes agree by chance as well
            mask = pa.array((equal - 1 / 256) / (1 - 1 / 256) >= least)
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def likely(pairs: DataFrame, n: int, heads: DataFrame, least: float, slots: int) -> DataFrame:
    """The pairs (a, b), ``n`` of them, of which signatures of either kind, by their low bytes, agree in a share of ``least`` or more."""
    both = join_hot(pairs, n, heads.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a", F.col("b"))
    both = both.join(heads.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_sifter(slots, least), "a long, b long")


def _texts_of(nodes: DataFrame, heads: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of ``nodes``; a short list goes to the texts, for a long one both are dealt by the text's key."""
    wanted, n = cut_small(nodes.join(heads.select("node", "doc", "k1", "k2"), "node"))
    found = texts.join(F.broadcast(wanted) if n <= BROADCAST_NODES else wanted, ["doc", "k1", "k2"])
    return cut(found.groupBy("node").agg(F.first("text").alias("text")))


def verify(pairs: DataFrame, n: int, heads: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> tuple[DataFrame, int]:
    """The pairs (a, b), ``n`` of them, whose texts are similar, and their number."""
    own = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), heads, texts)
    salted, first = pairs.withColumn("salt", F.lit(0)), own.select(F.col("node").alias("a"), F.col("text").alias("text_a"), F.lit(0).alias("salt"))
    if n > HOT_ROWS:  # the text of a node that many pairs have is sent to SALTS tasks
        hot = F.broadcast(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > hot_bound(n)).select(F.col("a").alias("hot")))
        salt = F.when(F.col("hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        salted = pairs.join(hot, F.col("a") == F.col("hot"), "left").select("a", "b", salt.alias("salt"))
        salts = F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        first = own.join(hot, F.col("node") == F.col("hot"), "left").select(F.col("node").alias("a"), F.col("text").alias("text_a"), F.explode(salts).alias("salt"))
    joined = salted.join(first, ["a", "salt"]).join(own.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return cut_small(joined.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(shingle, threshold), "a long, b long"))


def _pairs(rows: DataFrame, x: str, y: str) -> tuple[DataFrame, int]:
    return cut_small(rows.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())


def _block_sift(slots: int, least: float):
    """Rows of one block that any row of another class, on the other side, may be similar to, by their sketches."""

    def run(block: pa.Table) -> pa.Table:
        outside = np.array(block.column("outside").to_pylist(), bool)
        label, sketch = block.column("label").to_numpy(), block.column("sketch").to_pylist()
        x, y = np.flatnonzero(outside), np.flatnonzero(~outside)
        kinds = [np.frombuffer(b"".join(s[cut] for s in sketch), np.uint8).reshape(-1, slots) for cut in (slice(slots), slice(-slots, None))]
        use = np.zeros(len(label), bool)
        for i in x:
            equal = np.maximum(*((k[y] == k[i]).mean(axis=1) for k in kinds)) if len(y) else np.zeros(0)
            near = y[((equal - 1 / 256) / (1 - 1 / 256) >= least) & (label[y] != label[i])]
            use[near] = True
            use[i] = len(near) > 0
        return block.select(["group", "i", "j", "node", "label", "outside"]).filter(pa.array(use))

    return run


def _block_links(shingle: int, threshold: float):
    """Links between outsiders and members of one block, as few as connect what all its links connect."""

    def run(block: pa.Table) -> pa.Table:
        outside = np.array(block.column("outside").to_pylist(), bool)
        node, label = (block.column(c).to_numpy() for c in ("node", "label"))
        rows = _bag_list(block.column("text").combine_chunks(), shingle)
        x, y = np.flatnonzero(outside), np.flatnonzero(~outside)
        if not len(x) or not len(y):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        left, right = np.unique(np.concatenate([rows[i][0] for i in x])), np.unique(np.concatenate([rows[i][0] for i in y]))
        vocabulary = np.intersect1d(left, right, assume_unique=True)
        places, shared = [], []
        for element, count in rows:
            at = np.searchsorted(vocabulary, element)
            known = at < len(vocabulary)
            known[known] = vocabulary[at[known]] == element[known]
            places.append(at[known])
            shared.append(count[known])
        both, in_x, in_y = (np.zeros((len(x), len(y)), np.float32) for _ in range(3))
        for lo in range(0, len(vocabulary), BLOCK_COLUMNS):
            hi = min(len(vocabulary), lo + BLOCK_COLUMNS)
            tables = []
            for side in (x, y):
                one, part = np.zeros((len(side), hi - lo), np.float32), np.zeros((len(side), hi - lo), np.float32)
                for r, i in enumerate(side):
                    s, e = np.searchsorted(places[i], [lo, hi])
                    one[r, places[i][s:e] - lo] = 1
                    part[r, places[i][s:e] - lo] = shared[i][s:e] / rows[i][1].sum()
                tables += [one, part]
            both += tables[0] @ tables[2].T
            in_x += tables[1] @ tables[2].T
            in_y += tables[0] @ tables[3].T
        size = np.array([len(r[0]) for r in rows], np.float32)
        plain = both / np.maximum(size[x][:, None] + size[y][None] - both, 1)
        # the probability Jaccard similarity is at most the weight of what is shared on either side
        maybe = (plain >= threshold - 1e-4) | (np.minimum(in_x, in_y) >= threshold - 1e-4)
        maybe &= label[x][:, None] != label[y][None]
        up: dict[int, int] = {}

        def root(i: int) -> int:
            while (to := up.get(i, i)) != i:
                up[i] = i = up.get(to, to)
            return i

        links = []
        for i, j in zip(*np.nonzero(maybe), strict=True):
            a, b = root(int(label[x[i]])), root(int(label[y[j]]))
            if a != b and max(similarity(rows[x[i]], rows[y[j]])) >= threshold:
                up[max(a, b)] = min(a, b)
                links.append((int(node[x[i]]), int(node[y[j]])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _links_within(groups: DataFrame, heads: DataFrame, texts: DataFrame, threshold: float, shingle: int, slots: int) -> tuple[DataFrame, int]:
    """(a, b) links that connect the classes of each group (group, node, label), by exact comparison in blocks, and their number.

    Members of a group that are not of its largest class are the outsiders;
    blocks of about BLOCK outsiders or BLOCK_BYTES of their texts meet blocks of
    as many members, each pair of blocks in a task of its own.  Sketches are
    sent to all blocks, texts only where sketches say that two may be similar.
    """
    rows, n = cut_small(groups.join(heads.select("node", "n_bytes", "sketch"), "node"))
    largest = rows.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")).groupBy("group")
    largest = largest.agg(F.max_by("label", F.struct("n", "label")).alias("home"), F.sum("n").alias("n"), F.sum("b").alias("b"), (F.sum("n") - F.max("n")).alias("n_out"), (F.sum("b") - F.max_by("b", F.struct("n", "label"))).alias("b_out"))
    in_blocks = lambda n, b: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(b) / BLOCK_BYTES)).cast("int")
    rows = join_counted(rows, largest, "group", hot_bound(n), F.col("node")).where("n_out > 0").withColumns({"in_blocks": in_blocks("n", "b"), "out_blocks": in_blocks("n_out", "b_out")})
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["group", "i", "j", "node", "label", "sketch", "outside"]
    asks = rows.where("label <> home").select("*", own("out_blocks").alias("i"), all_of("in_blocks").alias("j"), F.lit(True).alias("outside")).select(*cols)
    members = rows.select("*", own("in_blocks").alias("j"), all_of("out_blocks").alias("i"), F.lit(False).alias("outside")).select(*cols)
    near, _ = cut_small(asks.unionByName(members).groupBy("group", "i", "j").applyInArrow(_block_sift(slots, threshold - SLACK), "group long, i int, j int, node long, label long, outside boolean"))
    own_texts = _texts_of(near.select("node").distinct(), heads, texts)
    return cut_small(near.join(own_texts, "node").groupBy("group", "i", "j").applyInArrow(_block_links(shingle, threshold), "a long, b long"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, k1, k2, text); texts are told apart by 128 bits of hash, a null id is the least integer and a null text empty."""
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_DOC)).alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")


def _classes(texts: DataFrame, threshold: float, shingle: int, bands: int, rows: int) -> tuple[DataFrame, int]:
    """(k1, k2, n, class_id, is_home) of every text of ``texts`` (doc, k1, k2, text), n times there, and the number of rows of ``texts``.

    ``class_id`` is the least id of the class; the text that comes first by id and hash is its home.
    """
    signed = texts.mapInArrow(_signer(shingle, bands, rows), "doc long, k1 long, k2 long, n_bytes long, bands array<long>, sketch binary")
    one = signed.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("n_bytes", "bands", "sketch")])
    # a node is a place in this table, which is read from the shared folder from here on
    seen = Observation()
    heads = cut(one.observe(seen, F.sum("n").alias("rows"), F.sum(F.size("bands")).alias("members")).select(F.monotonically_increasing_id().alias("node"), "*"))
    n_rows, n_members = seen.get["rows"] or 0, seen.get["members"] or 0

    members = heads.select("node", F.explode("bands").alias("bucket"))
    buckets = cut(members.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1"))
    members = cut(join_counted(members, buckets, "bucket", hot_bound(n_members), F.col("node")))

    def links(found: tuple[DataFrame, int]) -> tuple[DataFrame, int]:
        near = cut_small(likely(*found, heads, threshold - SLACK, bands * rows))
        return verify(*near, heads, texts, threshold, shingle)

    labels, n_labels = connected_components(*links(_pairs(members, "pivot", "node")))

    # members of buckets that are not of one class yet, with their class
    classed = members.where("n > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    torn, n_torn = cut_small(classed.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("n")).where("l <> m").select("bucket", "n"))
    if n_torn:
        rows_in = join_counted(classed.drop("n"), torn, "bucket", hot_bound(n_members), F.col("node"))
        torn_rows, _ = cut_small(rows_in)
        few = torn_rows.where(F.col("n") <= SMALL_BUCKET)
        home = few.where("node = pivot").select("bucket", F.col("label").alias("home"))
        asked = few.join(home, "bucket").where("label <> home").select("bucket", F.col("node").alias("asks"), F.col("label").alias("own"))
        meets = few.join(asked, "bucket").where("label <> own AND node <> pivot")
        more = [links(_pairs(meets, "node", "asks"))]
        # larger buckets of one pivot are much alike, and compared together
        many = torn_rows.where(F.col("n") > SMALL_BUCKET).select(F.col("pivot").alias("group"), "node", "label").distinct()
        more.append(_links_within(many, heads, texts, threshold, shingle, bands * rows))
        if n_more := sum(n for _, n in more):
            edges = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more[0][0]).unionByName(more[1][0])
            labels, n_labels = connected_components(edges, n_labels + n_more)

    own = labels.join(heads.select("node", "doc", "k1", "k2"), "node")
    firsts = own.groupBy("label").agg(F.min(F.struct("doc", "k1", "k2")).alias("home"), F.count("*").alias("n"))
    of_node = join_counted(labels, firsts, "label", hot_bound(n_labels), F.col("node")).select("node", "home")
    me = F.struct("doc", "k1", "k2")
    of_text = heads.select("node", "doc", "k1", "k2", "n").join(of_node, "node", "left").select("k1", "k2", "n", F.coalesce("home", me).alias("home"), me.alias("me"))
    return of_text.select("k1", "k2", "n", F.col("home.doc").alias("class_id"), (F.col("home") == F.col("me")).alias("is_home")), n_rows


def near_duplicate_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = SIMILARITY,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(doc, k1, k2, class_id, is_kept) for every row of ``docs``: the least id among all texts its text is linked with.

    Equal texts are always of one class.  Different texts are linked if their
    probability Jaccard or their plain Jaccard similarity is ``threshold`` or
    more, and classes are what links connect.  Null counts as empty; empty texts
    and other texts without words are linked with equal texts only.  Texts are
    told apart by 128 bits of hash, so ids may be null or clash: a null id is
    shown as the least integer, and classes with one least id stay classes of
    their own.  One row of each class ``is_kept``, the first by id and hash; of
    repeated rows any one.  Texts may have any length, an empty table stays
    empty, and other columns of ``docs``, whatever their names, play no part.
    With 32 bands of 5 slots a pair at 0.8 of either similarity is missed with a
    probability of 3e-6.
    """
    texts = _keyed(docs, id_col, text_col)
    classes, n = _classes(texts, threshold, shingle, bands, rows)
    listed = texts.groupBy("doc", "k1", "k2").agg(F.count("*").alias("copies"))
    found = join_counted(listed, classes, ["k1", "k2"], hot_bound(n), F.col("doc"), F.xxhash64("doc"))
    copies = found.select("doc", "k1", "k2", "class_id", "is_home", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return copies.select("doc", "k1", "k2", "class_id", (F.col("is_home") & (F.col("doc") == F.col("class_id")) & (F.col("copy") == 1)).alias("is_kept"))


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = SIMILARITY,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row of each class, the first by id and text hash, with all columns of ``docs`` as they were, whatever their names.

    Of repeated rows with that id and text one stays.  A null id counts as the
    least, a null text as empty; an empty table stays empty.
    """
    classes, _ = _classes(_keyed(docs, id_col, text_col), threshold, shingle, bands, rows)
    own, k1, k2 = fresh(docs, "own", "k1", "k2")
    kept = classes.where("is_home").select(F.col("class_id").alias(own), F.col("k1").alias(k1), F.col("k2").alias(k2))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    named = docs.select("*", F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_DOC)).alias(own), F.xxhash64(text).alias(k1), F.xxhash64(F.lit(1), text).alias(k2))
    # repeated rows are dropped before they are dealt
    return named.dropDuplicates([own, k1, k2]).join(kept, [own, k1, k2]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_probminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = near_duplicate_classes(docs)
    return classes.select(F.when(F.col("doc") != _NULL_DOC, F.col("doc")).alias("doc_id"), "class_id", "is_kept")
