"""Plain Python versions of the corpus operators, written from their contracts."""

import base64
import bisect
import collections
import hashlib
import itertools
import re
import zlib

import sentencepiece
import tokenizers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPACED.findall((text or "").translate(LOWER))


def terms(text):
    return TERMS.findall((text or "").translate(LOWER))


def measures(text):
    text = text or ""
    w = SPACED.findall(text)
    count = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if count[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(w) < 10 or 100 * len(covered) > 20 * len(w)}


def sentences(text):
    """(start, stop, words) of each run of words that ends with ``.``, ``!``, ``?`` or the line."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        found = []
        for m in SPACED.finditer(line):
            found.append(m)
            if m.group()[-1] in ".!?":
                out.append((at + found[0].start(), at + m.end(), [x.group().translate(LOWER) for x in found]))
                found = []
        if found:
            out.append((at + found[0].start(), at + found[-1].end(), [x.group().translate(LOWER) for x in found]))
        at += len(line) + 1
    return out


def repeats(docs, min_words):
    """(doc_id, start, stop, units, words, first document) of removed runs; ids are unique and not null."""
    first, later = {}, collections.defaultdict(list)
    for i, text in sorted(docs):
        for number, (start, stop, w) in enumerate(sentences(text)):
            key = " ".join(w)
            if first.setdefault(key, (i, number)) != (i, number):
                later[i].append((number, start, stop, len(w), first[key][0]))
    out = set()
    for i, found in later.items():
        runs = []
        for x in found:
            if runs and runs[-1][-1][0] + 1 == x[0]:
                runs[-1].append(x)
            else:
                runs.append([x])
        for run in runs:
            if sum(x[3] for x in run) >= min_words:
                longest = max(run, key=lambda x: (x[3], -x[0]))
                out.add((i, run[0][1], run[-1][2], len(run), sum(x[3] for x in run), longest[4]))
    return out


def cut(text, spans):
    """The text without its removed runs and one white space behind each; None if no word is left."""
    out, at = "", 0
    for a, b in sorted(spans):
        out += text[at:a]
        at = b + 1
    out += text[at:]
    if at >= len(text) and out[-1:] in tuple(" \t\n\v\f\r"):
        out = out[:-1]
    return out if SPACED.search(out) else None


def shingles(text, n=4):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(docs, percent=85, n=4):
    """doc_id -> (set size, least id reachable); ids are unique and not null."""
    sets = {i: shingles(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def windows(items, size=10):
    out = collections.defaultdict(set)
    for item, text in items:
        w = terms(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            out[tuple(w[i:i + k])].add(str(item))
    return out


def contaminated(text, found):
    """(words, hit positions, items)."""
    w = terms(text)
    hit, items = set(), set()
    for k in {len(x) for x in found}:
        for i in range(len(w) - k + 1):
            if ids := found.get(tuple(w[i:i + k])):
                hit.update(range(i, i + k))
                items |= ids
    return w, hit, items


def without_leaks(text, found):
    text = text or ""
    spots = [m.span() for m in TERMS.finditer(text.translate(LOWER))]
    _, hit, _ = contaminated(text, found)
    if not hit:
        return text
    if len(hit) == len(spots):
        return None
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(text[at:spots[i][0]])
        at = spots[i][1]
    return "".join(out) + text[at:]


def sha1_base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def phrases(text, base):
    w = terms(text)
    starts, labels = [], set()
    for phrase, label in base:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), starts, labels


def good_hosts(failed, limit=0.5):
    """``failed``: (host, whether a document fails). Hosts whose rate, shrunk by a beta prior fitted by moments, is in the limit."""
    docs, bad = collections.Counter(h for h, _ in failed), collections.Counter(h for h, f in failed if f)
    k, n = len(docs), len(failed)
    m = sum(bad.values()) / n
    spread = sum(bad[h] ** 2 / docs[h] for h in docs) - n * m * m - (k - 1) * m * (1 - m)
    between = spread / (n - sum(x * x for x in docs.values()) / n) if k > 1 else 0
    strength = max(2.0, min(10_000.0, m * (1 - m) / between - 1 if between > 0 else 10_000.0))
    return {h for h in docs if (bad[h] + m * strength) / (docs[h] + strength) <= limit}


def trie(rows):
    """Nodes of the rebuilt conversations; ``rows``: (conv_id, turn, role, text)."""
    conv = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v, key=lambda z: z[:3])] for c, v in conv.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        new[c] = own.get(base, [])[:h] + v[h:]
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        s = (len(m) - 1) * len(SPACED.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += s
            leaves[p[:d]] += not kids[p]
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(
        ",".join(str(c) for c in sorted(m) if len(new[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()]


def letter_grams(text, orders):
    """How often each character n-gram occurs, in order of the counts."""
    out = collections.Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        w = f" {w} "
        out.update(w[i:i + k] for k in orders for i in range(len(w) - k + 1) if w[i:i + k] != " ")
    return sorted(out.values())


def alignment(rows, byte_path, piece_path):
    """The rows of the token alignment, from the two libraries; ``rows``: (doc_id, text)."""
    a_side = tokenizers.Tokenizer.from_file(byte_path)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    byte_of = {(chr(b) if b in plain else chr(next(rest))): b for b in range(256)}

    def a_bytes(i):
        return bytes(byte_of[c] for c in a_side.id_to_token(i))

    def b_bytes(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()

    docs, count = [], collections.Counter()
    for i, text in rows:
        full = (" " + (text or "")).encode()
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        if b"".join(map(a_bytes, a)) != full or b"".join(map(b_bytes, b)) != full:
            docs.append((i, [], [], []))
            continue
        ends_a = list(itertools.accumulate(len(a_bytes(x)) for x in a))
        ends_b = list(itertools.accumulate(len(b_bytes(x)) for x in b))
        groups, ia, ib = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            ja, jb = bisect.bisect_right(ends_a, cut), bisect.bisect_right(ends_b, cut)
            groups.append((a[ia:ja], b[ib:jb]))
            ia, ib = ja, jb
        docs.append((i, a, b, groups))
        count.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    best = collections.Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, a, b, groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out
