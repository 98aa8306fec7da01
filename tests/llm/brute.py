"""Plain versions of the operators for small tables: rows are dicts with ``doc_id, text, source``."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def token_files(rows, tokenizer):
    out, start = {}, 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        out[r["doc_id"]] = (start, len(ids), zlib.crc32(b"".join(n.to_bytes(4, "little") for n in ids)))
        start += len(ids)
    return out


def bpe(rows, tokenizer):
    out = {}
    for r in rows:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        out[r["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    return out


def licenses(rows):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    out = {}
    for r in rows:
        words = PLAIN.findall((r["text"] or "").translate(LOWER))
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p)
        ends = (places[0][0], places[-1][0]) if places else (None, None)
        out[r["doc_id"]] = (len(words), len(places), *ends, ",".join(sorted({x for _, x in places})))
    return out


def license_labels(text, templates, run=3, near=3, cover=0.6):
    """Labels of the templates that the words of a text cover, diagonal by diagonal."""
    words = PLAIN.findall((text or "").translate(LOWER))
    found = {}
    for label, notice in templates:
        target = PLAIN.findall(notice.translate(LOWER))
        runs = len(target) - run + 1
        places = defaultdict(set)
        for at in range(len(words) - run + 1):
            for place in range(runs):
                if words[at : at + run] == target[place : place + run]:
                    places[at - place].add(place)
        band, bands, last = 0, {}, None
        for d in sorted(places):
            band += last is not None and d - last > near
            bands[d], last = band, d
        for d in places:
            mates = [e for e in places if bands[e] == bands[d] and d <= e <= d + runs + near]
            score = len(set().union(*(places[e] for e in mates))) / runs
            if score >= cover:
                found[label] = max(found.get(label, 0), score)
    return found


def phrases(rows, width=13):
    words = {r["doc_id"]: (r["text"] or "").encode().split() for r in rows}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - width + 1):
            first.setdefault(tuple(words[k][i : i + width]), k)
    out = {}
    for k, w in words.items():
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < k for j in range(i, i + width)}
        out[k] = (len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def strings(rows, width=200):
    data = {r["doc_id"]: (r["text"] or "").encode() for r in rows}
    count = Counter(b[i : i + width] for b in data.values() for i in range(len(b) - width + 1))
    out = {}
    for k, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out[k] = (len(b), sum(gone), spans, sha(bytes(x for x, y in zip(b, gone) if not y)))
    return out


def similar(rows, percent=80):
    sets = {}
    for r in rows:
        w = WORD.findall((r["text"] or "").translate(LOWER))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for k in sorted(sets):
        common = Counter(o for s in sets[k] for o in held[s])
        for s in sets[k]:
            held[s].append(k)
        for o, n in common.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[o]) - n):
                a, b = sorted((root(k), root(o)))
                parent[b] = a
    return {k: (len(sets[k]), root(k)) for k in sets}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def personal(rows):
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    out = {}
    for r in rows:
        found = [(m.start(), k, m.end()) for k, (_, p, good) in enumerate(patterns) for m in re.finditer(p, r["text"] or "") if good(m[0])]
        counts = Counter(k for _, k, _ in found)
        out[r["doc_id"]] = (*[counts[k] for k in range(4)], ",".join(f"{patterns[k][0]}:{s}:{e}" for s, k, e in sorted(found)))
    return out


def line_key(line):
    return line.strip(" \t\r\x0b\x0c").lower()


def line_spread(rows, min_sites):
    sites, first = defaultdict(set), {}
    texts = defaultdict(set)
    for r in rows:
        for line in {line_key(x) for x in (r["text"] or "").split("\n")} - {""}:
            sites[line].add(r["source"])
            texts[line].add(r["text"])
            first[line] = min(first.get(line, r["doc_id"]), r["doc_id"])
    out = {}
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if len(sites[line_key(x)]) < min_sites or len(texts[line_key(x)]) < 2 or not line_key(x) or first[line_key(x)] == r["doc_id"]]
        out[r["doc_id"]] = (len(lines) - len(kept), "\n".join(kept))
    return out


def line_hash(r, line):
    return int(hashlib.md5(f"{r['source']}\n{' '.join(WORD.findall(line.translate(LOWER)))}".encode()).hexdigest()[:15], 16)


def good(rows, least=20, share=0.01, left=0.3):
    """Ids that the quality rules keep, with the texts without common lines."""
    keys, words = {}, {}
    for r in rows:
        found = {}
        for line in (r["text"] or "").translate(LOWER).split("\n"):
            w = WORD.findall(line)
            if w:
                key = int(hashlib.md5(f"{r['source']}\n{' '.join(w)}".encode()).hexdigest()[:15], 16)
                found.setdefault(key, []).append(len(w))
        keys[r["doc_id"]], words[r["doc_id"]] = found, WORD.findall(r["text"] or "")
    texts, hosts = defaultdict(set), Counter(s for s, _ in {(r["source"], r["text"] or "") for r in rows})
    for r in rows:
        for key in keys[r["doc_id"]]:
            texts[key].add(r["text"])
    out = {}
    for r in rows:
        w = words[r["doc_id"]]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(windows)
        repeated = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 3)}
        lost = sum(sum(n) for k, n in keys[r["doc_id"]].items() if len(texts[k]) > max(least, share * hosts[r["source"]]))
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and len(w) - lost >= left * len(w):
            lines = (r["text"] or "").split("\n")
            common = [len(texts[line_hash(r, x)]) > max(least, share * hosts[r["source"]]) for x in lines]
            out[r["doc_id"]] = "\n".join(x for x, gone in zip(lines, common) if not gone)
    return out


def contaminated(rows, items):
    targets = set()
    for x in items:
        w = tuple(PLAIN.findall((x["text"] or "").translate(LOWER)))
        n = min(len(w), 13)
        targets |= {w[i : i + n] for i in range(len(w) - n + 1)} if n else set()
    lengths = {len(t) for t in targets}
    out = set()
    for r in rows:
        w = tuple(PLAIN.findall((r["text"] or "").translate(LOWER)))
        hit = {j for n in lengths for i in range(len(w) - n + 1) if w[i : i + n] in targets for j in range(i, i + n)}
        if hit and 20 * len(hit) >= len(w):
            out.add(r["doc_id"])
    return out
