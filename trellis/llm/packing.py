"""Cost-balanced packing of token sequences.

A document's cost is linear in its tokens plus quadratic (attention). Documents are tokenized and packed in one
pass over bounded groups of one input partition: each group has as many sequences as its tokens fill, its
documents are placed in descending order on the sequence of lowest cost that has room, and a document that no
sequence can hold whole is cut over those with room left. So every sequence of a group but the last is full, and
no row is shuffled at all.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY, LINEAR, QUADRATIC = 1024, 1.0, 1.0 / 1024
#: Tokens gathered before a group is packed; at most one partly filled sequence a group, so padding stays under 0.1 %.
GROUP_TOKENS = 1 << 20
END = (0).to_bytes(4, "little")
_SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cost(n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    """Cost of one piece of n tokens that attends within itself."""
    return linear * n + quadratic * n * n


def pack(sizes: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents of the given sizes, and the number of sequences.

    Ties go to the earlier document and the lower sequence. Empty documents have no piece.
    """
    pieces, total = [], sum(sizes)
    count = -(-total // capacity)
    full = 0
    tails = []
    for d, n in enumerate(sizes):
        whole = n // capacity
        for i in range(whole):
            pieces.append((d, i * capacity, capacity, full + i, 0))
        full += whole
        if n % capacity:
            tails.append((n % capacity, d, whole * capacity))
    # The last sequence takes what the full ones leave.
    last = total - (count - 1) * capacity if count else 0
    room = {s: capacity for s in range(full, count)}
    if count > full:
        room[count - 1] = last
    load = dict.fromkeys(room, 0.0)
    placed: dict[int, int] = dict.fromkeys(room, 0)
    limit = {s: room[s] for s in room}
    tails.sort(key=lambda x: (-x[0], x[1]))
    waiting = []

    def put(d, start, n, s):
        pieces.append((d, start, n, s, placed[s]))
        placed[s] += n
        load[s] += cost(n, linear, quadratic)

    # Sequences by the room that is left, cheapest first; over the rooms a tree of minima, which finds the cheapest with enough.
    size = 1 << capacity.bit_length()
    none = (float("inf"), -1)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(size)]
    best = [none] * (2 * size)

    def renew(r):
        at = size + r
        best[at] = heaps[r][0] if heaps[r] else none
        while at > 1:
            at //= 2
            best[at] = min(best[2 * at], best[2 * at + 1])

    for s, r in room.items():
        heaps[r].append((0.0, s))
    for r in set(room.values()):
        heapq.heapify(heaps[r])
        renew(r)
    for n, d, start in tails:
        low, high, found = size + n, 2 * size, none
        while low < high:
            if low & 1:
                found = min(found, best[low])
                low += 1
            if high & 1:
                high -= 1
                found = min(found, best[high])
            low //= 2
            high //= 2
        s = found[1]
        if s < 0:
            waiting.append((n, d, start))
            continue
        r = limit[s] - placed[s]
        heapq.heappop(heaps[r])
        renew(r)
        put(d, start, n, s)
        if r > n:
            heapq.heappush(heaps[r - n], (load[s], s))
            renew(r - n)
    queue = [x for h in heaps for x in h]
    heapq.heapify(queue)
    for n, d, start in waiting:
        while n:
            _, s = heapq.heappop(queue)
            part = min(n, limit[s] - placed[s])
            put(d, start, part, s)
            start, n = start + part, n - part
            if placed[s] < limit[s]:
                heapq.heappush(queue, (load[s], s))
    return pieces, count


_bpe = {}


def _tokenizer(file: str):
    from trellis.llm.tokens import ByteBPE

    if file not in _bpe:
        _bpe[file] = ByteBPE(file)
    return _bpe[file]


def _packer(file: str, capacity: int, linear: float, quadratic: float, group: int):
    def run(batches):
        bpe = _tokenizer(file)
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 36
        made = 0
        docs: list[tuple[object, bytes]] = []
        held = 0
        kind = None

        def flush():
            nonlocal made, docs, held
            pieces, count = pack([len(ids) // 4 for _, ids in docs], capacity, linear, quadratic)
            cols = [[], [], [], [], [], [], []]
            for d, start, n, s, offset in pieces:
                key, ids = docs[d]
                for c, x in zip(cols, (key, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, base + made + s, offset)):
                    c.append(x)
            made += count
            docs, held = [], 0
            return pa.record_batch([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            kind = b.schema.field(0).type
            keys = b.column(0).to_pylist()
            for key, text in zip(keys, b.column(1)):
                ids = bpe.ids(text.as_py() or "") + END
                docs.append((key, ids))
                held += len(ids) // 4
                if held >= group:
                    yield flush()
        if docs:
            yield flush()

    return run


def pack_documents(docs: DataFrame, file: str = "byte_bpe_50k.json", capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, group: int = GROUP_TOKENS) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the one end token. Repeated rows are packed each. sequence_id counts within the
    input partition, so it is unique and the same when a task runs again. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_packer(file, capacity, linear, quadratic, group), f"doc_id {kind}, {_SCHEMA}")
