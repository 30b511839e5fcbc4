"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio.

Two models of character pairs are trained from labelled samples: random strings (label 1) and ordinary identifiers
(label 0).  A run of token characters whose mean log-likelihood ratio a transition passes a threshold is a secret of kind
`markov`; of a run that does not, the parts between joining characters that do (the key of name=key or path/key).  What a
pattern has already is cut out before.  Without samples of the user's own, `samples()` makes labelled ones by rule.

Runs are found with numpy over the bytes of a slice of rows, so only runs and the texts that hold a keyword are looked at one
by one.  No shuffle; the models are a few kB.

Cases: null text is empty and has no spans; texts of any length are scanned whole; positions are code points, the end
exclusive; ids may be null or repeat; only the named columns are read.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

KINDS = ("assign", "access", "hex", "markov")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = ("password", "passwd", "secret", "token", "api")
ASSIGN = re.compile("(" + "|".join(map(_either, _WORDS[:4])) + "|" + _either("api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Shortest run that the models judge, and the threshold in nats a transition.
RUN, THRESHOLD = 16, 0.55
_CLASS = np.zeros(256, bool)
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
#: Characters of runs that join words; parts of a run begin and end at them.
_JOINS = np.zeros(128, bool)
_JOINS[list(b"+/_=-")] = True

#: Words from which the rule makes ordinary identifiers.
ORDINARY = (
    "account action address array async average batch before binary block buffer cache callback change channel character child client cluster "
    "collection column command commit common compare config connection constant container content context control convert count create current "
    "database default delete dependency description device directory distance document element enable encoding engine entry environment error "
    "event example exception execute export factory feature field filter format function general generate graph group handle header history "
    "identifier image import index information input instance integer internal international interface item iterator journal language layer length "
    "library license limit listener local location manager mapping matrix measure member memory merge message method model module monitor network "
    "notification number object operation option order organization original output package parameter parent parser partition password pattern "
    "performance permission pointer position predicate prefix process production profile project property protocol provider quality query random "
    "reader record reference region register relation remote render report request resource response result return schedule schema search section "
    "security segment selection sequence server service session setting signature singleton snapshot source stable standard statement status storage "
    "stream string structure subject symbol system table target template temporary test text the thing thread threshold time token transaction "
    "transform translation transport tree tuple type understanding unit update user validation value variable vector version view visible web window "
    "with word worker writer nation tion ing and that this there other and of in on er en an re "
    # the commonest words of identifiers and texts in German, French and Spanish, without accents
    "abfrage abschnitt adresse anfang anzeige arbeit auftrag ausgabe auswahl bearbeiten benutzer bereich beschreibung beziehung datei eigenschaft eingabe einheit einstellung entwicklung ergebnis fehler freiheit funktion "
    "geschwindigkeit gesellschaft gleichzeitig grenze haeufigkeit inhalt knopf kunde laufzeit leistung loeschen meldung moeglichkeit nachricht netzwerk nutzung passwort pfad pflicht pruefung rechnung schaltung schluessel "
    "schreiben schutz sicherheit speicher sprache suche tabelle uebersicht umgebung verbindung verzeichnis vorschlag werkzeug wichtigkeit zahlung zeichen zeitpunkt zugriff zukunft zusammen zwischen "
    "affichage ajouter appareil beaucoup bureau choix client couleur dernier donnees eau environ erreur essai etat exemple fichier fonction heureux jeu joyeux langue lecture lieu lieux logiciel longueur mieux mise modifier "
    "monde mot niveau nombre nouveau nouveaux objet oiseau ouvrir page paiement parametre pays plusieurs pouvoir premier principaux produit qualite question quelque recherche reseau reseaux sauvegarde seulement sortie suivant tableau tableaux utilisateur valeur vente vieux ville "
    "accion actualizar ahora anuncio aplicacion archivo ayuda bajo busqueda cambio ciudad clave codigo compra conexion contrasena correo cuenta datos despues direccion ejemplo enlace entonces error escribir espacio estado "
    "ejecucion fecha funcion gasto hoja imagen informacion inicio lectura lenguaje lista mejor mensaje mientras muchos nivel noticia nuevo numero pagina pais pantalla pedido permiso persona precio proceso producto prueba pueblo registro respuesta salida seccion siguiente sistema tabla tiempo trabajo usuario valores vacio"
).split()


def samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled strings made by rule: random ones over the alphabets of keys, and identifiers joined from words."""
    rng = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [low + up + dig, low + up + dig + "+/", low + up + dig + "-_", low + dig, up + dig, "0123456789abcdef"]
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 48))), 1) for _ in range(n)]
    for _ in range(n):
        w = rng.choices(ORDINARY, k=rng.randint(2, 5))
        style = rng.randrange(6)
        s = ["_".join(w), "-".join(w), w[0] + "".join(x.capitalize() for x in w[1:]), "".join(w), "_".join(w).upper(), "/".join(w)][style]
        out.append((s + rng.choice(["", "", "", str(rng.randrange(100)), "_" + str(rng.randrange(10))]), 0))
    return out


def _states(s: bytes) -> np.ndarray:
    return np.frombuffer(s, np.uint8) & 127


def train(labelled) -> np.ndarray:
    """Log-likelihood ratio of each pair of characters, random over ordinary, with a start state; add-one smoothing over the
    characters that runs hold."""
    counts = np.zeros((2, 128, 128))
    alphabet = np.flatnonzero(_CLASS)
    counts[:, :, alphabet] = 0.5
    for text, label in labelled:
        x = np.r_[0, _states(text.encode("ascii", "ignore"))]
        np.add.at(counts[int(label)], (x[:-1], x[1:]), 1)
    p = counts / np.maximum(counts.sum(axis=2, keepdims=True), 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log(p[1]) - np.log(p[0])
    return np.where(np.isfinite(ratio), ratio, 0.0)


def score(ratio: np.ndarray, run: bytes) -> float:
    """Mean log-likelihood ratio of the run's transitions."""
    x = np.r_[0, _states(run)]
    return float(ratio[x[:-1], x[1:]].mean())


def _free(a: int, b: int, spans) -> list[tuple[int, int]]:
    """The stretches of a..b that no span covers."""
    out = []
    for s, e in sorted((s, e) for _, s, e in spans if s < b and e > a):
        if s > a:
            out.append((a, s))
        a = max(a, e)
    return [*out, (a, b)] if a < b else out


def random_parts(ratio: np.ndarray, run: bytes, threshold: float) -> list[tuple[int, int]]:
    """The whole run if its mean passes the threshold; or else those of its parts, of RUN characters or more between two of the
    characters that join words, whose mean does: first the one that passes by the largest sum, then those on either side."""
    if len(run) < RUN:
        return []
    if score(ratio, run) > threshold:
        return [(0, len(run))]
    x = _states(run)
    word = ~_JOINS[x]
    starts, ends = np.flatnonzero(word & np.r_[True, ~word[:-1]]), np.flatnonzero(word & np.r_[~word[1:], True]) + 1
    total = np.r_[0.0, np.cumsum(ratio[x[:-1], x[1:]])]  # of the transitions up to each character
    over = total - threshold * np.arange(len(x))
    first = ratio[0, x[starts]]  # of the transition from the start state
    out, todo = [], [(0, len(starts))]
    while todo:
        lo, hi = todo.pop()
        if lo >= hi or ends[hi - 1] - starts[lo] < RUN:
            continue
        before = over[starts[lo:hi]] - first[lo:hi] + threshold
        n = np.searchsorted(starts[lo:hi], ends[lo:hi] - RUN, "right")  # so many starts are far enough before each end
        sums = np.where(n > 0, over[ends[lo:hi] - 1] - np.minimum.accumulate(before)[n - 1], -np.inf)
        j = int(sums.argmax())
        if not sums[j] > 0:
            continue
        i, j = lo + int(before[: n[j]].argmin()), lo + j
        # words beside it that look random belong to it as long as the mean passes; what is before or after = does not
        mean = lambda i, j: (first[i] + total[ends[j] - 1] - total[starts[i]]) / (ends[j] - starts[i])
        while i > lo and b"=" not in run[ends[i - 1] : starts[i]] and first[i - 1] + total[starts[i]] - total[starts[i - 1]] > first[i] and mean(i - 1, j) > threshold:
            i -= 1
        while j + 1 < hi and b"=" not in run[ends[j] : starts[j + 1]] and total[ends[j + 1] - 1] > total[ends[j] - 1] and mean(i, j + 1) > threshold:
            j += 1
        out.append((int(starts[i]), int(ends[j])))
        todo += [(lo, i), (j + 1, hi)]
    return out


def _spans(text: str, runs: list[tuple[int, int]], ratio: np.ndarray, threshold: float, has_word: bool) -> list[tuple[str, int, int]]:
    """runs: code point spans of long runs of token characters."""
    out = []
    if has_word:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    assigned, at = out[:], 0  # in order, as the runs are
    for a, b in runs:
        run = text[a:b]
        # matches of these two lie within one run of token characters
        known = [("access", a + m.start(), a + m.end()) for m in ACCESS.finditer(run) if m.end() - m.start() >= LEAST["access"]] if "AKIA" in run else []
        known += [("hex", a + m.start(), a + m.end()) for m in HEX.finditer(run) if m.end() - m.start() >= LEAST["hex"]]
        out += known
        while at < len(assigned) and assigned[at][2] <= a:
            at += 1
        end = at
        while end < len(assigned) and assigned[end][1] < b:
            end += 1
        for s, e in _free(a, b, known + assigned[at:end]):
            out += [("markov", s + i, s + j) for i, j in random_parts(ratio, text[s:e].encode(), threshold)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_slice(texts: pa.Array, ratio: np.ndarray, threshold: float = THRESHOLD) -> list[list[tuple[str, int, int]]]:
    """The spans of each text."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or ends[-1] == ends[0]:
        return [[] for _ in range(len(texts))]
    buf = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _CLASS[buf]
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    inner = ends[(ends > 0) & (ends < len(buf))]
    before[inner], after[inner - 1] = False, False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    long = last - first >= RUN
    first, last = first[long], last[long]
    row = np.searchsorted(ends, first, "right") - 1
    points = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
    first, last = points[first] - points[ends[row]], points[last] - points[ends[row]]
    begin = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        a, b = begin[i], begin[i + 1]
        own = buf[ends[i] : ends[i + 1]].tobytes()
        lower = own.lower()
        has_word = any(w in lower for w in (b"password", b"passwd", b"secret", b"token", b"api"))
        out.append(_spans(own.decode(), list(zip(first[a:b].tolist(), last[a:b].tolist(), strict=True)), ratio, threshold, has_word) if a < b or has_word else [])
    return out


def scan_secrets(docs: DataFrame, labelled=None, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, spans (array of kind, start, end, sorted by start and then kind).  labelled: (string, 0 or 1) rows, a
    bounded sample, for the models."""
    ratio = train(labelled if labelled is not None else samples())
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, "text"):
                found = scan_slice(T.column(part, "text"), ratio, threshold)
                rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(rows, pa.list_(span))], ["doc_id", "text", "spans"])

    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return own.mapInArrow(run, "doc_id long, text string, spans array<struct<kind: string, start: long, end: long>>")


def mask(text: str | None, spans) -> str | None:
    """The text with each span (overlapping ones as one) replaced by a mark of its kind."""
    if not spans:
        return text
    out, at = [], 0
    merged: list = []
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"], s["kind"]])
    for a, b, kind in merged:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, labelled=None, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The table with every span in the texts masked; all rows and columns stay."""
    ratio, names = train(labelled if labelled is not None else samples()), docs.columns
    at = names.index(text_column)

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, text_column):
                texts = part.column(at).to_pylist()
                found = scan_slice(T.column(part, text_column), ratio, threshold)
                clean = [mask(t, [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]) for t, spans in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(clean, part.schema.field(at).type), *part.columns[at + 1 :]], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, and the joined spans of a scan."""
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *map(_count, KINDS[:3]), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), _count(KINDS[3]))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))
