"""Exact Jaccard join of word n-gram sets by a token-group matrix.

A text's set holds its distinct runs of words.  Similar texts are partitioned
into groups of bounded size, by the least hash of their sets.  A group is opened
once to compare its own members.  The matrix of tokens and groups then says
which other groups a text may have links into, and it is kept in two forms.
Rows of (token, group) hold the tokens that members need to share: of the
``n - ceil(t * n) + l`` first tokens of each set, rarest first, two sets of
similarity ``t`` share ``l``.  And of every larger group that such rows lead to
the whole union of tokens is stored; the overlap of a query with the union
bounds its overlap with each member, so that only groups that qualify are
opened, and their members compared exactly.

What is joined are texts, not rows: copies of one text are one node.  Only
links between different components matter, so a group whose members are of the
query's own component is passed over; a large family of linked texts is met once
and not as all of its pairs.  Rare and frequent tokens are told apart by counts
in a table of fixed size; any fixed order of the tokens gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm.bytewords import _BASE, IS_BLANK, Words, blocks, mix
from trailmark.llm.common import HOT_ROWS, cut, cut_small, hot_bound, join_counted, table
from trailmark.llm.components import connected_components
from trailmark.llm.neardup import BROADCAST_NODES, _NULL_DOC, _keyed, bags

SHINGLE = 3
#: Least similarity in percent.
PERCENT = 90
#: Two sets share one of their first tokens for each so many tokens that they have.
SHARE = 20
#: Texts of one group, and bytes of them.
GROUP, GROUP_BYTES = 256, 1 << 22
#: Slots of the table of token counts, which is broadcast as one byte for each.
SLOTS = 1 << 22
#: Slots whose counts are summed up together.
SLOT_BLOCK = 1 << 12
#: Slots that hold more than one in so many of all tokens of texts are frequent, so at most so many are.
OFTEN = 100_000
#: Tokens that a comparison looks at together.
COLUMNS = 8192
_U = np.uint64


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, text, token, bytes) of blocks of rows: the distinct tokens of each text, in order."""
    for i, j, data, off in blocks(column):
        doc, token, _ = bags(Words(data, off, ~IS_BLANK), shingle)
        yield i, j, doc, token, np.diff(off)


def _slot(token: np.ndarray) -> np.ndarray:
    return (token >> _U(20)).astype(np.int64) & (SLOTS - 1)


def token_levels(texts: DataFrame, shingle: int) -> np.ndarray:
    """How frequent the tokens of each slot are: the binary logarithm of the number of texts that have one.

    Every task counts all slots; its counts are dealt in blocks of slots, and
    each block is summed up as it comes in.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for _, _, _, token, _ in _sets(batch.column(0), shingle):
                slot, n = np.unique(_slot(token), return_counts=True)
                total[slot] += n.astype(np.uint32)
        rows = total.reshape(-1, SLOT_BLOCK)
        for i in range(0, len(rows), 64):
            some = i + np.flatnonzero(rows[i : i + 64].any(axis=1))
            # in as many bytes for a count as the largest of the block takes
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array([rows[b].astype(np.min_scalar_type(rows[b].max())).tobytes() for b in some], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(counts, f"u{len(counts) // SLOT_BLOCK}").astype(np.int64)
        levels = [np.log2(np.maximum(n, 1)).astype(np.uint8).tobytes() for n in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["block", "levels"])

    dealt = texts.select("text").mapInArrow(count, "block int, counts binary").repartition("block")
    out = np.zeros((SLOTS // SLOT_BLOCK, SLOT_BLOCK), np.uint8)
    for row in dealt.mapInArrow(add, "block int, levels binary").collect():  # a byte for each slot
        out[row["block"]] = np.frombuffer(row["levels"], np.uint8)
    return out.reshape(-1)


def frequent_level(levels: np.ndarray) -> int:
    """Least level of frequent slots; a token of any other slot has fewer texts than two to the power of it."""
    return int(np.ceil(np.log2(max(HOT_ROWS, float(np.exp2(levels.astype(np.float64)).sum()) / OFTEN))))


def _signer(levels, shingle: int, percent: int, often: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            for i, j, doc, token, n_bytes in _sets(batch.column(3), shingle):
                order = np.lexsort((token, level[_slot(token)], doc))
                doc, token = doc[order], token[order]
                size = np.bincount(doc, minlength=j - i)
                first = np.cumsum(size) - size
                needed = np.where(size > 0, size - -(-size * percent // 100) + -(-size // SHARE), 0)
                keep = np.arange(len(doc)) - first[doc] < needed[doc]
                key = np.zeros(j - i, np.uint64)
                some = np.flatnonzero(size)
                if len(some):
                    key[some] = np.minimum.reduceat(mix(token ^ _BASE), first[some])
                rare = np.bincount(doc[keep & (level[_slot(token)] < often)], minlength=j - i)  # they come first
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(needed)]).astype(np.int32)), pa.array(token[keep].view(np.int64)))
                columns = [*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(n_bytes.astype(np.int64)), pa.array(size), pa.array(key.view(np.int64)), lists, pa.array(rare.astype(np.int32))]
                yield pa.record_batch(columns, names=["doc", "k1", "k2", "n_bytes", "size", "key", "prefix", "rare"])

    return run


def _read(column: pa.ChunkedArray, shingle: int) -> list[np.ndarray]:
    """The set of each text, its tokens in order."""
    out: list[np.ndarray] = []
    for i, j, doc, token, _ in _sets(column.combine_chunks(), shingle):
        at = np.searchsorted(doc, np.arange(j - i + 1))
        out += [token[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) numbers of common tokens of sets (arrays in order)."""
    out = np.zeros((len(left), len(right)), np.float32)
    vocabulary = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)

    def place(tokens: np.ndarray) -> np.ndarray:
        at = np.searchsorted(vocabulary, tokens)
        at = at[at < len(vocabulary)]
        return at[vocabulary[at] == tokens[: len(at)]]

    places = [[place(s) for s in side] for side in (left, right)]
    for lo in range(0, len(vocabulary), COLUMNS):
        hi = min(len(vocabulary), lo + COLUMNS)
        tables = []
        for side in places:
            one = np.zeros((len(side), hi - lo), np.float32)
            for r, p in enumerate(side):
                s, e = np.searchsorted(p, [lo, hi])
                one[r, p[s:e] - lo] = 1
            tables.append(one)
        out += tables[0] @ tables[1].T
    return out


def links(sets: list[np.ndarray], node: np.ndarray, label: np.ndarray, asks: np.ndarray, percent: int) -> pa.Table:
    """(a, b): links between texts that ask and all others of other labels, as few as connect what all links connect."""
    found: list[tuple[int, int]] = []
    x, y = np.flatnonzero(asks), np.arange(len(node))
    if len(x) and len(y) > 1:
        common = overlaps([sets[i] for i in x], sets)
        size = np.array([len(s) for s in sets], np.int64)
        close = 100 * common.astype(np.int64) >= percent * (size[x][:, None] + size[None] - common.astype(np.int64))
        close &= label[x][:, None] != label[None]
        up: dict[int, int] = {}

        def root(i: int) -> int:
            while (to := up.get(i, i)) != i:
                up[i] = i = up.get(to, to)
            return i

        for i, j in zip(*np.nonzero(close), strict=True):
            a, b = root(int(label[x[i]])), root(int(label[y[j]]))
            if a != b:
                up[max(a, b)] = min(a, b)
                found.append((int(node[x[i]]), int(node[y[j]])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _open(percent: int, shingle: int):
    def run(cell: pa.Table) -> pa.Table:
        node, label = (cell.column(c).to_numpy() for c in ("node", "label"))
        return links(_read(cell.column("text"), shingle), node, label, np.array(cell.column("asks").to_pylist(), bool), percent)

    return run


def _union(shingle: int):
    """The union of the tokens of a group, and the size of its least set."""

    def run(group: pa.Table) -> pa.Table:
        sets = _read(group.column("text"), shingle)
        return pa.table({"b": group.column("b")[:1], "tokens": pa.array([np.unique(np.concatenate(sets)).tobytes()], pa.binary()), "least": pa.array([min(map(len, sets))], pa.int64())})

    return run


def _bound(percent: int, shingle: int):
    """Queries of a cell whose overlap with the group's union allows for a link with a member."""

    def run(cell: pa.Table) -> pa.Table:
        query = np.array(cell.column("asks").to_pylist(), bool)
        [g] = np.flatnonzero(~query)
        union, least = np.frombuffer(cell.column("tokens")[g].as_py(), np.uint64), cell.column("least")[g].as_py()
        asks = cell.filter(pa.array(query))
        use = []
        for tokens in _read(asks.column("text"), shingle):
            n = len(tokens)
            most = int(np.isin(tokens, union, assume_unique=True).sum())
            use.append((100 + percent) * most >= percent * (n + max(least, -(-n * percent // 100))))
        return asks.select(["cell", "node"]).filter(pa.array(use, pa.bool_()))

    return run


def _texts_of(nodes: DataFrame, heads: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of ``nodes``, dealt by node; they are not kept, so a join by node that follows takes them where they are."""
    wanted, n = cut_small(nodes.join(heads.select("node", "doc", "k1", "k2"), "node"))
    found = texts.join(F.broadcast(wanted) if n <= BROADCAST_NODES else wanted, ["doc", "k1", "k2"])
    return found.groupBy("node").agg(F.first("text").alias("text"))


def _seated(seats: DataFrame, heads: DataFrame, texts: DataFrame) -> DataFrame:
    """``seats`` (node, ...) with text: those of one row as they are read, not dealt by node first; of copies one is taken."""
    wanted, n = cut_small(seats.join(heads.select("node", "doc", "k1", "k2", F.col("n").alias("copies")), "node"))
    alone, copied = (wanted.where(x) for x in ("copies = 1", "copies > 1"))
    once = texts.join(F.broadcast(alone) if n <= BROADCAST_NODES else alone, ["doc", "k1", "k2"])
    own = _texts_of(copied.select("node").distinct(), heads, texts)
    return once.select(*seats.columns, "text").unionByName(copied.select(*seats.columns).join(own, "node"))


def shared_tokens(heads: DataFrame, n_tokens: int) -> DataFrame:
    """(node, token, often) of the first tokens that two nodes or more have.

    Rare tokens have few nodes each, so their rows are dealt once and counted
    where they are; those of frequent slots are counted before they are dealt.
    """
    some = lambda start, n: heads.select("node", F.explode(F.slice("prefix", start, n)).alias("token"))
    rare = some(F.lit(1), F.col("rare")).withColumn("n", F.count("*").over(Window.partitionBy("token"))).where("n > 1").select("node", "token", F.lit(False).alias("often"))
    often = some(F.col("rare") + 1, F.size("prefix") - F.col("rare"))
    counts = cut(often.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"))
    return rare.unionByName(join_counted(often, counts, "token", hot_bound(n_tokens), F.col("node")).select("node", "token", F.lit(True).alias("often")))


def torn_tokens(known: DataFrame, n_tokens: int) -> DataFrame:
    """``known`` (token, often, label, ...) with ``home``, of tokens that two labels or more have: the label with most of the rows of a token."""
    most = F.struct("m", "label")
    rare, of_token = known.where(~F.col("often")).repartition("token"), Window.partitionBy("token")
    rare = rare.withColumn("m", F.count("*").over(Window.partitionBy("token", "label")))
    rare = rare.withColumns({"home": F.max(most).over(of_token)["label"], "one": F.min("label").over(of_token) == F.max("label").over(of_token)}).where(~F.col("one")).drop("m", "one")
    often = known.where("often")
    counted = often.groupBy("token", "label").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("label", most).alias("home"), F.sum("m").alias("n"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    return rare.unionByName(join_counted(often, counted, "token", hot_bound(n_tokens), F.col("node")).drop("n"))


def matrices(torn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each token and group that has it, of rare and of frequent tokens.

    Rare tokens are dealt by token once, and met with themselves where they are.
    A frequent one may be in very many texts, so its rows are put together before.
    """
    rows = lambda some: some.groupBy("token", "key", "part").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.min("size").alias("least"), F.max("size").alias("most"), F.max("away").alias("away"))
    return rows(torn.where("NOT often").repartition("token")), cut(rows(torn.where("often")))


def _components(heads: DataFrame, n_nodes: int, n_tokens: int, texts: DataFrame, percent: int, shingle: int) -> tuple[DataFrame, int]:
    """(node, label) of all nodes with links, and their number."""
    rows = heads.where("size > 0").select("node", "key", "n_bytes", "size")
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"), F.min("node").alias("pivot")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("b") / GROUP_BYTES), F.lit(1))
    grouped = join_counted(rows, keys, "key", hot_bound(n_nodes), F.col("node"), keep=True)
    grouped = cut(grouped.select("node", "key", "size", F.pmod(F.xxhash64("node"), F.coalesce(parts, F.lit(1))).cast("int").alias("part"), "pivot", (F.coalesce(parts, F.lit(1)) > 1).alias("cut")))

    # groups are opened to compare their own members; one text of a family is in all of its groups
    own = grouped.where("pivot IS NOT NULL")
    seats = own.select("node", "key", "part").unionByName(own.where("cut").select(F.col("pivot").alias("node"), "key", "part").distinct()).distinct()
    opened = _seated(seats, heads, texts).select("key", "part", "node", F.col("node").alias("label"), "text", F.lit(True).alias("asks"))
    found, n_found = cut_small(opened.groupBy("key", "part").applyInArrow(_open(percent, shingle), "a long, b long"))
    labels, n_labels = connected_components(found, n_found)

    # the matrix: of tokens that two or more components need, the groups that have them
    info = grouped.join(labels, "node", "left").select("node", "key", "part", "size", F.coalesce("label", "node").alias("label"))
    # rare and frequent tokens are read once each, so these rows, the most of all, are not kept
    known = shared_tokens(heads, n_tokens).join(info, "node")
    torn, n_torn = cut_small(torn_tokens(known, n_tokens).withColumn("away", F.col("label") != F.col("home")).drop("home"))
    if not n_torn:
        return labels, n_labels
    q, g = F.struct(F.col("q_key").alias("key"), F.col("q_part").alias("part")), F.struct("key", "part")
    once = (q != g) & (~F.col("away") | (q < g))
    near = (F.col("least") * percent <= F.col("q_most") * 100) & (F.col("q_least") * percent <= F.col("most") * 100)
    differ = F.least("l", "q_l") != F.greatest("m", "q_m")

    def meet(matrix: DataFrame) -> DataFrame:
        asking = matrix.where("away").select("token", *[F.col(c).alias(f"q_{c}") for c in ("key", "part", "l", "m", "least", "most")])
        return asking.join(matrix, "token").where(once & near & differ).select(F.least(q, g).alias("a"), F.greatest(q, g).alias("b"), F.least("least", "q_least").alias("least"))

    rare, often = map(meet, matrices(torn))
    met = rare.unionByName(often)
    enough = F.col("tokens") >= F.ceil(F.col("least") / SHARE)
    cells, n_cells = cut_small(met.groupBy("a", "b").agg(F.count("*").alias("tokens"), F.min("least").alias("least")).where(enough).select("a", "b", F.monotonically_increasing_id().alias("cell")))
    if not n_cells:
        return labels, n_labels

    # queries are bounded by the union of each group, and what qualifies is compared with its members
    wanted = cells.select(F.explode(F.array("a", "b")).alias("g")).distinct()
    members = torn.select("node", F.struct("key", "part").alias("g"), "label").distinct().join(wanted, "g")
    members = cut(members.join(_texts_of(members.select("node"), heads, texts), "node"))
    alone = members.groupBy("g").agg(F.count("*").alias("n")).where("n = 1").select(F.col("g").alias("b"))
    large = cells.join(alone, "b", "left_anti")
    held = members.select(F.col("g").alias("b"), "node", "text")
    unions = held.join(large.select("b").distinct(), "b", "left_semi").groupBy("b").applyInArrow(_union(shingle), "b struct<key: long, part: int>, tokens binary, least long")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    queries = members.select(F.col("g").alias("a"), "node", "text")
    ask = large.join(queries, "a").select("cell", "node", "text", none("binary", "tokens"), none("long", "least"), F.lit(True).alias("asks"))
    groups = large.join(unions, "b").select("cell", none("long", "node"), none("string", "text"), "tokens", "least", F.lit(False).alias("asks"))
    bounded = ask.unionByName(groups).groupBy("cell").applyInArrow(_bound(percent, shingle), "cell long, node long")
    # of a group of one text the union is its set, and it is compared at once
    direct = cells.join(alone, "b", "left_semi").join(queries, "a").select("cell", "node")
    qualified, _ = cut_small(bounded.unionByName(direct))
    # members are dealt once, by their group; a group asks with those that qualify, GROUP of them at most, and answers with all
    asks = cells.join(qualified.groupBy("cell").agg(F.collect_set("node").alias("own")), "cell")
    sides = asks.select("cell", F.col("a").alias("g"), "own").unionByName(asks.select("cell", F.col("b").alias("g"), F.lit(None).cast("array<long>").alias("own")))
    opened = sides.join(members, "g").where("own IS NULL OR array_contains(own, node)").select("cell", "node", "label", "text", F.col("own").isNotNull().alias("asks"))
    more, n_more = cut_small(opened.groupBy("cell").applyInArrow(_open(percent, shingle), "a long, b long"))
    if not n_more:
        return labels, n_labels
    edges = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more)
    return connected_components(edges, n_labels + n_more)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc, n_shingles, component_id) for every row of ``docs``: the least id that its links lead to.

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a text
    of fewer than ``shingle`` words has one token, all of them.  Two texts are
    linked if their sets have ``percent`` of their union in common or more; all
    links are found.  Null, empty and blank texts have no tokens and no links, not
    even with their like, and are components of their own.  Rows with equal texts
    are linked, whatever their ids, unless the texts have no tokens; of null ids
    a component takes no notice unless it has no other, and its id is null then.
    Texts may have any length, an empty table stays empty, and other columns of
    ``docs``, whatever their names, play no part.
    """
    texts = _keyed(docs, id_col, text_col)
    levels = token_levels(texts, shingle)
    often = frequent_level(levels)
    levels = docs.sparkSession.sparkContext.broadcast(levels)
    signed = texts.mapInArrow(_signer(levels, shingle, percent, often), "doc long, k1 long, k2 long, n_bytes long, size long, key long, prefix array<long>, rare int")
    least = F.coalesce(F.min(F.when(F.col("doc") != _NULL_DOC, F.col("doc"))), F.lit(_NULL_DOC))
    one = signed.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), least.alias("id"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("n_bytes", "size", "key", "prefix", "rare")])
    seen = Observation()
    heads = cut(one.observe(seen, F.sum("n").alias("rows"), F.count("*").alias("nodes"), F.sum(F.size("prefix")).alias("tokens")).select(F.monotonically_increasing_id().alias("node"), "*"))
    n_rows, n_nodes, n_tokens = (seen.get[c] or 0 for c in ("rows", "nodes", "tokens"))

    labels, n_labels = _components(heads, n_nodes, n_tokens, texts, percent, shingle)
    firsts = labels.join(heads.select("node", "id"), "node").groupBy("label").agg(F.coalesce(F.min(F.when(F.col("id") != _NULL_DOC, F.col("id"))), F.lit(_NULL_DOC)).alias("least"), F.count("*").alias("n"))
    of_node = join_counted(labels, firsts, "label", hot_bound(n_labels), F.col("node")).select("node", "least")
    of_text = heads.join(of_node, "node", "left").select("k1", "k2", "n", "size", F.coalesce("least", "id").alias("component"))
    found = join_counted(texts.select("doc", "k1", "k2"), of_text, ["k1", "k2"], hot_bound(n_rows), F.col("doc"), F.xxhash64("doc", F.monotonically_increasing_id()))
    shown = lambda c: F.when(F.col(c) != _NULL_DOC, F.col(c))
    return found.select(shown("doc").alias("doc"), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, shown("component")).otherwise(shown("doc")).alias("component_id"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


OP13_SQL = f"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT rid, shingle FROM (SELECT rid, unnest(CASE WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS shingle FROM src WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM sets GROUP BY rid),
common AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM sets a JOIN sets b USING (shingle) WHERE a.rid <> b.rid GROUP BY ALL),
linked AS (SELECT x, y FROM common JOIN sizes a ON a.rid = x JOIN sizes b ON b.rid = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
reached AS (SELECT rid AS x, rid AS y FROM src UNION SELECT r.x, l.y FROM reached r JOIN linked l ON l.x = r.y)
SELECT s.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM reached JOIN src s ON s.rid = x JOIN src o ON o.rid = y LEFT JOIN sizes ON sizes.rid = x GROUP BY x, s.doc_id
"""
