"""Plain versions that several tests share."""

import collections


def brute_repeats(rows, length, first):
    """(doc_id, bytes of the text, what stays) of rows (doc_id, text, ...): every string of the length that also starts elsewhere goes, or all but its first."""
    seen, at = collections.Counter(), {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    texts = [(rows[i][1] or "").encode() for i in range(len(rows))]
    for i in order:
        for p in range(len(texts[i]) - length + 1):
            w = texts[i][p : p + length]
            seen[w] += 1
            at.setdefault(w, (i, p))
    out = []
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if at[w] != (i, p) if first else seen[w] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((rows[i][0], len(t), bytes(b for b, g in zip(t, gone) if not g)))
    return out
