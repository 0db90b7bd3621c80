"""Plain versions of operators, for comparison."""

import math
import re
from collections import Counter

from weftline.llm import html_text, pii, urls


def plain_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    label = {i: i for i in sets}
    ids = list(sets)
    for _ in ids:
        changed = False
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a], changed = label[b], True
        if not changed:
            break
    return {i: (len(sets[i]), label[i]) for i in ids}


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def plain_terms(texts, share=0.9):
    """Best share of every disclosing term, counted over distinct texts in plain loops."""
    n_term, n_entity, n_both, texts = Counter(), Counter(), Counter(), {t or "" for t in texts}
    for text in texts:
        spans = plain_spans(text)
        bare = "".join(" " if any(s <= i < e for s, _, e in spans) else c for i, c in enumerate(text))
        terms = set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", bare.lower()))
        entities = {(kind, text[s:e]) for s, kind, e in spans}
        n_term.update(terms)
        n_entity.update(entities)
        n_both.update((e, t) for e in entities for t in terms)
    best = {}
    for (entity, term), n in n_both.items():
        prior = n_entity[entity] / len(texts)
        if prior < 1:
            told = math.log((n + prior) / (n_term[term] + 1) / prior) / -math.log(prior)
            if told >= share:
                best[term] = max(told, best.get(term, 0))
    return best


def plain_chats(rows):
    """All branches with a root, by walking up from every leaf."""
    out, trees = {}, {}
    for tree, node, parent, role, text, score in rows:
        trees.setdefault(tree, {})[node] = (parent, role, text or "", score)
    for tree, nodes in trees.items():
        up = {n: p for n, (p, *_) in nodes.items() if p in nodes and p != n}
        found = []
        for leaf in nodes.keys() - set(up.values()):
            path = [leaf]
            while path[-1] in up and len(path) <= len(nodes):
                path.append(up[path[-1]])
            if len(path) <= len(nodes):
                found.append((-sum(nodes[n][3] for n in path), leaf, path[::-1]))
        for rank, (score, leaf, path) in enumerate(sorted(found), 1):
            turns = [nodes[n][1:3] for n in path]
            out[tree, leaf] = (rank, -score, turns, "".join(t for r, t in turns if r == "assistant"))
    return out


def plain_verdicts(rows, edges):
    """Verdict of every (url, html) row, by spreading votes along edges until nothing changes."""

    def parts(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        return host, m[2] if m else "", (host + re.sub("/$", "", m[2]) + (m[3] or "") if host else None)

    def rule(url):
        host, path, _ = parts(url)
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.host + r.path), default=None)

    group = {parts(u)[2]: {parts(u)[2]} for e in edges for u in e}
    for a, b in [(parts(a)[2], parts(b)[2]) for a, b in edges]:
        union = group[a] | group[b]
        for key in union:
            group[key] = union
    votes = {}
    for url in [u for e in edges for u in e] + [u for u, _ in rows]:
        if rule(url):
            votes.setdefault(parts(url)[2], set()).add(rule(url).verdict)
    out = {}
    for i, (url, _) in enumerate(rows):
        host, path, key = parts(url)
        own, said = rule(url), set().union(*(votes.get(k, set()) for k in group.get(key, ())))
        out[i] = (host, path, own and own.host + own.path, own.verdict if own else "allow" if "allow" in said or not said else "block")
    return out


def plain_main_text(pages):
    """Main text and number of shared lines: neighbours in one sorted list, subsequences by a table."""
    rows = []
    for i, url, page in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        rows.append((m[1].lower() if m else "", m[2] if m else "", str(i), i, *html_text.text_lines(page)))
    rows.sort(key=lambda x: x[:3])
    out = {}
    for at, (host, path, _, i, lines, roles) in enumerate(rows):
        best = None
        for other in rows[max(0, at - 1) : at] + rows[at + 1 : at + 2]:
            if host and other[0] == host:
                alike = next((k for k in range(min(len(path), len(other[1]))) if path[k] != other[1][k]), min(len(path), len(other[1])))
                if best is None or alike > best[0]:
                    best = (alike, other[4])
        shared = {k for k in html_text.common_lines(lines, best[1]) if roles[k] != html_text.KEPT} if best else set()
        is_open = {k for k, role in enumerate(roles) if role == html_text.OPEN}
        if is_open and is_open <= shared and html_text.KEPT not in roles:
            shared -= is_open
        out[i] = ("\n".join(x for k, x in enumerate(lines) if roles[k] != html_text.DROPPED and k not in shared), len(shared))
    return out
