"""Plain single-machine versions the operators are compared with."""

import hashlib
import re


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def contamination(docs, benchmark):
    patterns = {}
    for item, text in benchmark:
        words = plain_words(text)
        if item is None or not words:
            continue
        size = min(10, len(words))
        for i in range(len(words) - size + 1):
            patterns.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    sizes = {len(p) for p in patterns}
    out = []
    for doc, text in docs:
        words = plain_words(text)
        hit, items = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                found = patterns.get(tuple(words[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    items |= found
        out.append((doc, len(words), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return out


def tokens(docs, ranks, pattern):
    import struct

    import tiktoken

    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = []
    for doc, text in docs:
        ids = library.encode_ordinary(text or "")
        out.append((doc, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode_bytes(ids))))
    return out


def licenses(docs, templates):
    import math

    sizes = [len(plain_words(t.text)) for t in templates]
    out = []
    for doc, text in docs:
        words = plain_words(text)
        places, shares, labels = [], [], set()
        for t, size in zip(templates, sizes):
            sequence = plain_words(t.text)
            longest = max(n for n in sizes if (n - 1).bit_length() == (size - 1).bit_length())
            if t.phrase:
                for i in range(len(words) - len(sequence) + 1):
                    if words[i : i + len(sequence)] == sequence:
                        places.append((t.label, i))
                        shares.append(1.0)
                continue
            distinct = set(sequence)
            for begin in range(0, len(words), longest):
                common = len(distinct & set(words[begin : begin + 2 * longest]))
                if common >= math.ceil(t.share * len(distinct) - 1e-9):
                    shares.append(common / len(distinct))
                    labels.add(t.label)
        base = {label for label, _ in places}
        starts = [i for _, i in places]
        out.append(
            (doc, len(words), len(places), min(starts, default=None), max(starts, default=None),
             ",".join(sorted(base)), ",".join(sorted(base | labels)), max(shares, default=0.0))
        )
    return out


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = n * 2 - (9 if n > 4 else 0)
        total += n
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    for rank, (kind, pattern) in enumerate(zip(("email", "ip", "card", "phone"), patterns)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and _luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def personal(docs):
    out = []
    for doc, text in docs:
        spans = base_spans(text)
        kinds = [s[2] for s in spans]
        listed = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)
        out.append((doc, *(kinds.count(k) for k in ("email", "ip", "card", "phone")), sha(listed)))
    return out


def edited(docs):
    """doc_id to (n_chars, edited text, next text) for distinct ids."""
    ordered = sorted(docs, key=lambda d: -d[0])
    out = {}
    for i, (doc, text) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        out[doc] = (len(text), text[: len(text) - third] + following[:third], following)
    return out


def shingles(text):
    words = blank_words((text or "").lower())
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def substring_dedup(docs, window=50):
    first = {}
    split = [(doc, blank_words(text)) for doc, text in docs]
    for doc, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


def suffix_dedup(docs, length=400):
    counts = {}
    split = [(doc, (text or "").encode()) for doc, text in docs]
    for _, data in split:
        for i in range(len(data) - length + 1):
            key = hash(data[i : i + length])
            counts[key] = counts.get(key, 0) + 1
    out = []
    for doc, data in split:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if counts[hash(data[i : i + length])] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        out.append((doc, len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone) if not g))))
    return out


def jaccard_components(docs):
    sets = []
    for doc, text in docs:
        words = blank_words(ascii_lower(text))
        sets.append((doc, {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()))
    holders = {}
    for i, (_, own) in enumerate(sets):
        for s in own:
            holders.setdefault(s, []).append(i)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, own) in enumerate(sets):
        common = {}
        for s in own:
            for j in holders[s]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= 75 * (len(own) + len(sets[j][1]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(own), least[find(i)]) for i, (doc, own) in enumerate(sets)]


def usable_vectors(rows):
    """``(id, label, vector)`` of rows with a finite vector, shorter ones with zeros behind."""
    import math

    kept = [(i, label, v) for i, label, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max([1, *(len(v) for _, _, v in kept)])
    return [(i, label, [float(c) for c in v] + [0.0] * (dims - len(v))) for i, label, v in kept], dims


def vector_codes(rows, parts=16, entries=64, rounds=2):
    import math

    kept, dims = usable_vectors(rows)
    wide = -(-dims // parts)
    whole = [[math.floor(256 * c) for c in v] + [0] * (wide * parts - dims) for _, _, v in kept]
    seeds = sorted((i, v, n) for n, (i, _, v) in enumerate(kept) if i is not None)[:entries]
    codes, errors, books = ["" for _ in kept], [0 for _ in kept], []
    for p in range(parts):
        own = [x[p * wide : (p + 1) * wide] for x in whole]
        book = [list(own[n]) for _, _, n in seeds] or [[0] * wide]

        def nearest(v):
            return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(book))

        for _ in range(rounds):
            found = [nearest(v)[1] for v in own]
            for k in range(len(book)):
                members = [v for v, f in zip(own, found) if f == k]
                if members:
                    book[k] = [sum(c) // len(members) for c in zip(*members)]
        for n, v in enumerate(own):
            error, k = nearest(v)
            codes[n] += f"{k:02x}"
            errors[n] += error
        books += book
    digest = sha(",".join(str(c) for entry in books for c in entry))
    totals = {}
    for (_, label, _), error in zip(kept, errors):
        totals[label] = totals.get(label, 0) + error
    return [(i, code, error, totals[label], digest) for (i, label, _), code, error in zip(kept, codes, errors)]


def whitening(rows, components=16):
    """Rows ``(id, deviation)``, whitened values (rows x components), shares of variance and ``n``."""
    import numpy as np

    kept, dims = usable_vectors(rows)
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, _, v in kept], dtype=np.int64)
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    there = values > dims * np.finfo(float).eps * values[0]
    values, vectors = values[there], vectors[:, there]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return [(i, d) for (i, _, _), d in zip(kept, deviation)], (x - sums / n) @ vectors / np.sqrt(values), values / np.trace(covariance), n


def token_files(docs, tokenizer_path, end=2):
    import struct
    import zlib

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = True
    return [
        (doc, len(ids) + 1, zlib.crc32(struct.pack(f"<{len(ids) + 1}I", *ids, end)))
        for doc, ids in ((doc, tokenizer.encode(text or "", add_special_tokens=False).ids) for doc, text in docs)
    ]
