"""Plain-Python twins of the scan contracts."""

import hashlib
import re

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c)
        if i % 2:
            v = v * 2 - (9 if v > 4 else 0)
        t += v
    return t % 10 == 0


def digest(spans, order):
    spans = sorted(spans, key=lambda s: (s[1], order.index(s[0]), s[2]))
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return text, hashlib.sha256(text.encode()).hexdigest()


def secrets(text):
    t = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return out, digest(out, ["assign", "access", "hex"])


def pii(text):
    t = text or ""
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(only(m[0])) <= 15]
    return out, digest(out, ["email", "ip", "card", "phone"])


CONTEXT = {
    "email": "email e-mail mail contact kontakt correo courriel",
    "ip": "ip host server address addr adresse",
    "card": "card visa mastercard amex credit debit karte carte tarjeta",
    "phone": "phone tel call mobile fax telefon telephone téléphone teléphone télephone telefono teléfono",
    "iban": "iban bank account konto compte cuenta",
}


def ibans(text):
    run = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
    at = 0
    while at < len(text):
        m = run.match(text, at) if at == 0 or not re.match("[A-Za-z0-9]", text[at - 1]) else None
        if m:
            plain = m[0].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                yield "iban", m.start(), m.end()
            at = m.end()
        else:
            at += 1


def pii_scored(text):
    """All spans with their scores, in report order."""
    t = text or ""
    spans = pii(t)[0] + list(ibans(t))
    order = list(CONTEXT)
    out = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], order.index(s[0]), s[2])):
        near = False
        for word in CONTEXT[kind].split():
            for m in re.finditer(rf"(?<!\w){word}(?!\w)", t, re.I):
                near |= (a - 40 <= m.start() and m.end() <= a) or (b <= m.start() and m.end() <= b + 40)
        out.append((f"{kind}:{a}:{b}", f"{0.5 + 0.3 * (kind in ('card', 'iban')) + 0.2 * near:.2f}"))
    return out


PLACEHOLDER = re.compile("example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|test|foobar|123456", re.I)


def candidates(text):
    """(start, end, value, looks live) of every base span's own secret."""
    for kind, a, b in secrets(text)[0]:
        value = ASSIGN.fullmatch(text[a:b])[2] if kind == "assign" else text[a:b]
        mixed = re.search("[0-9]", value) and re.search("[A-Za-z]", value)
        password = kind == "assign" and text[a:b].lower().startswith("passw")
        likely = len(set(value)) >= 8 and not PLACEHOLDER.search(value)
        yield b - len(value), b, value, bool(likely and (kind == "access" or password or mixed))


def redacted(rows):
    """doc_id to text with the live secrets of (doc_id, text, owner, language) rows masked."""
    owners, repos, looks = {}, {}, {}
    for _, text, owner, lang in rows:
        for _, _, v, live in candidates(text or ""):
            owners.setdefault(v, set()).add(owner)
            repos.setdefault(v, set()).add((owner, lang))
            looks[v] = looks.get(v, False) or live
    out = {}
    for d, text, _, _ in rows:
        spans = sorted({(a, b) for a, b, v, _ in candidates(text or "") if looks[v] and len(owners[v]) <= 2 and len(repos[v]) <= 3})
        made, at = [], 0
        for a, b in spans:
            if a >= at:
                made += [text[at:a], "[secret]"]
            at = max(at, b)
        out[d] = "".join(made) + text[at:] if spans else text
    return out
