"""The quality and chat queries against plain versions of themselves, over whole tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomspark.llm import chat, quality


def rows_of(sf, table):
    return pq.read_table(f"{sf}/{table}.parquet").to_pylist()


def test_quality_query_equals_plain_neighbours(spark, sf):
    """Every document's cosines with all voters, sorted in double precision."""
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in rows_of(sf, "documents")}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    voters = sorted((r["doc_id"], r["quality"]) for r in rows_of(sf, "labels") if r["quality"] in (0, 1) and not held(r["doc_id"]) and r["doc_id"] in docs)
    voters.sort(key=lambda v: repr(v[0]))
    assert quality.NEIGHBOURS < len(voters) < quality.MAX_LABELLED
    fitted = np.array([quality.features(docs[i]) for i, _ in voters]).astype(np.float16).astype(np.float32)
    labels = np.array([y for _, y in voters])
    model = quality.Model.fit(fitted.copy(), labels)
    latent = lambda x: (x.astype(np.float64) - model.mean) @ model.axes
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)
    near = unit(latent(fitted))
    got = {r.doc_id: r for r in quality.op5_neighbour_quality(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        cosine = near @ unit(latent(quality.features(text)))
        top = np.argsort(-cosine, kind="stable")[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[top], 0) ** quality.POWER
        want = (weight @ labels[top] + quality.PRIOR * quality.PRIOR_SCORE) / (weight.sum() + quality.PRIOR)
        assert got[i].score == pytest.approx(want, abs=2e-3) and got[i].held_out == held(i)
        assert got[i].predicted == int(got[i].score >= 0.7)


def test_chat_query_equals_plain_decoding(spark, sf):
    """Counts by dictionaries, then the best path through all lines of each conversation, each line with a table of its own."""
    conversations = defaultdict(list)
    for r in sorted(rows_of(sf, "conversations"), key=lambda r: (r["conv_id"], r["turn"], r["role"] or "", r["text"] or "")):
        conversations[r["conv_id"]].append(r)
    first, following, seen = Counter(), Counter(), Counter()
    for conv, turns in conversations.items():
        if zlib.crc32(str(conv).encode()) % 4 == 2:
            continue
        known = [chat.ALIASES.get((r["role"] or "").strip().lower()) for r in turns]
        if known[0] is not None:
            first[known[0]] += 1
        following.update((a, b) for a, b in zip(known, known[1:]) if a is not None and b is not None)
        for role, r in zip(known, turns):
            if role is not None:
                lines = (r["text"] or "").split("\n")
                marked = [i for i, x in enumerate(lines) if i and chat.read_line(x)[0] is not None]
                part = [chat.read_line(x)[1] for x in lines[: marked[0] if marked else len(lines)]]
                seen.update((k, value, role) for k, value in enumerate(chat.features(part)))
    base = chat.UNTRAINED  # the prior alone; its probabilities weigh PRIOR
    share = lambda logs, counted, total: math.log((chat.PRIOR * math.exp(logs) + counted) / (chat.PRIOR + total))
    start = [share(base.first[s], first[s], first.total()) for s in range(3)]
    step = [[share(base.next[p][s], following[p, s], sum(following[p, x] for x in range(3))) for s in range(3)] for p in range(3)]
    totals = Counter()
    for (k, _, role), n in seen.items():
        totals[k, role] += n
    emitted = lambda k, value, s: share(base.emit[k][value][s], seen[k, value, s], totals[k, s])
    want = {}
    for conv, turns in conversations.items():
        lines = []  # (turn, scores, begins a part)
        for r in turns:
            read = [chat.read_line(x) for x in (r["text"] or "").split("\n")]
            begins = [i for i, (m, _) in enumerate(read) if not i or m is not None]
            for a, b in zip(begins, [*begins[1:], len(read)]):
                values = chat.features([x for _, x in read[a:b]])
                scores = [sum(emitted(k, v, s) for k, v in enumerate(values)) + (chat.MARKED if read[a][0] == s else 0) for s in range(3)]
                lines += [(r["turn"], scores, True)] + [(r["turn"], [0.0] * 3, False)] * (b - a - 1)
        table = [[(start[s] + lines[0][1][s], None) for s in range(3)]]
        for _, scores, begins in lines[1:]:
            jump = step if begins else chat.STAY
            table.append([max(((table[-1][p][0] + jump[p][s], p) for p in range(3)), key=lambda x: (x[0], -x[1])) for s in range(3)])
            table[-1] = [(value + scores[s], p) for s, (value, p) in enumerate(table[-1])]
        state = max(range(3), key=lambda s: (table[-1][s][0], -s))
        path = [state]
        for row in reversed(table[1:]):
            path.append(row[path[-1]][1])
        path.reverse()
        for (turn, *_), s in zip(lines, path):
            roles = want.setdefault((conv, turn), [])
            if not roles or roles[-1] != chat.ROLES[s]:
                roles.append(chat.ROLES[s])
    got = defaultdict(list)
    for r in sorted(chat.op6_transcript_roles(spark, sf).collect(), key=lambda r: (r.conv_id, r.turn, r.part)):
        got[r.conv_id, r.turn].append(r.role)
    assert got == want
