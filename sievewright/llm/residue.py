"""Template residue, error pages, notices and filler in place of real text: found and left out.

Labelled exemplars of residue are held in an inverted index (token -> exemplars, token -> topics). A text is cut into
passage windows: as long as a sentence of each retrieved exemplar, whose TF-IDF containment in the window, and the
window's in it, decides; and, because messages are worded in many ways, the windows that a topic's wording contains
best: the exemplars of one topic together hold the words that such messages are made of. A text is excluded when its
residue windows cover it but for a title.
Document frequencies of the exemplars' tokens are counted over all texts of the column; the index is bounded by the
list of exemplars, not by the data.

Defined cases: null and blank texts, and N/A markers, are no residue; texts are read whole; ties between exemplars give the same
answer; repeated rows each come out; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import arrow_map

#: Labelled exemplars (fixed values): messages that public servers, content systems, browsers and templates write, by
#: topic, after "topic =". Host names, numbers and identifiers leave no tokens.
EXEMPLARS = """
topic = scripts
Please enable JavaScript to view this page. You need to enable JavaScript to run this app.
JavaScript is disabled in your browser. This site requires JavaScript to be enabled; please turn it on and reload the page.
This page needs scripts to work properly; your browser does not support scripts, or they are blocked, switched off or not allowed.
We have detected that scripting is off. To use all features, content, article, preview and reader of this website switch it on in settings, or use another, newer or more modern browser.
Sorry, your browser is not supported or out of date. Update, upgrade or use a different one to continue, display, see, show or open the full text. Unable to load without it; it relies on scripts.
Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite nutzen, sehen oder anzeigen zu können. Diese Website benötigt JavaScript; es ist deaktiviert.
Veuillez activer JavaScript dans votre navigateur pour afficher cette page. Ce site a besoin de JavaScript pour fonctionner; il est désactivé.
Active JavaScript en su navegador para continuar, ver o usar esta página. Este sitio necesita JavaScript; está desactivado. Por favor, habilite.
Ative o JavaScript no seu navegador para continuar, ver ou usar esta página. Este site precisa do JavaScript; está desativado. Por favor, habilite.
Attiva JavaScript nel tuo browser per continuare a vedere questa pagina. Il sito richiede JavaScript.
Включите JavaScript в браузере, чтобы открыть, просмотреть или использовать эту страницу. Для работы сайта требуется JavaScript.
このページを表示するにはJavaScriptを有効にしてください。ブラウザの設定でJavaScriptが無効になっています。ご利用
请启用JavaScript后再访问本页面。您的浏览器已禁用JavaScript，请在设置中开启以继续浏览、查看网站。
이 페이지를 보려면 자바스크립트를 활성화해 주세요. 브라우저에서 JavaScript를 사용하도록 설정하십시오.
topic = cookies
We use cookies to improve your experience on our website. By continuing to browse, visit or use this site you agree to our use of cookies and privacy policy.
Cookies are disabled in your browser. Please enable cookies and reload; this site must be able to set, store and accept cookies to work.
Cookie settings, preferences and notice. Accept all, reject all, manage or customise. Some cookies are necessary, others help us with analytics, to personalise content and advertising; learn more.
This website uses cookies to ensure you get the best experience. Got it, I agree, OK, decline, allow, consent, close.
Wir verwenden Cookies, um Ihr Erlebnis zu verbessern. Alle akzeptieren, ablehnen, Einstellungen. Diese Website nutzt Cookies.
Ce site utilise des cookies pour améliorer votre expérience. Tout accepter, refuser, paramètres. Nous utilisons.
Este sitio utiliza cookies para mejorar su experiencia. Aceptar todo, rechazar, configuración. Utilizamos, usamos.
topic = robots
Please verify that you are a human. Are you a robot? Complete the action, captcha, challenge or test below, tick, check or click the box to go on, continue or proceed.
Checking your browser before accessing the site. Just a moment, this process is automatic, please wait a few seconds; you will be redirected shortly.
One more step: please complete the security check to access this page. Finish it to reach what you asked for. Why do I have to complete a captcha?
Our systems have detected unusual traffic or activity from your computer, network or address. Automated requests, bots and crawlers were blocked. We need to confirm that it is you and not a program.
Sorry, you have been blocked. Attention required. Bot protection, verification and firewall active; performance and security by. Your request has been blocked. Reference, request, support, incident or ray id.
Prove you are not a robot; type the characters or letters you see in the image, picture. Verifying connection is secure. Press and hold the button.
Bitte bestätigen Sie, dass Sie kein Roboter sind. Sicherheitsprüfung. Einen Moment bitte.
Veuillez confirmer que vous n'êtes pas un robot. Vérification de sécurité. Un instant.
Confirme que no es un robot. Comprobación de seguridad. Un momento, por favor.
Подтвердите, что вы не робот. Проверка безопасности. Подождите.
请完成验证以证明您不是机器人。安全验证，请稍候。正在检查您的浏览器。
topic = missing
The page you are looking for could not be found. Page not found. It may have been moved, removed, deleted, renamed or never existed, or is no longer available; the link is broken, expired, outdated or wrong.
Oops! Sorry, we can't find the page, article, document, item, resource, record or file you requested, wanted, asked for or were after. Go back, return to the previous or home page, homepage, start, or try a search. That does not exist; nothing here, something is gone or missing.
404 Not Found. The requested URL, address or resource was not found on this server. 410 Gone. HTTP status error. Check the spelling and try again.
The identifier or DOI you entered could not be resolved, was not recognised or does not exist. DOI not found.
Seite nicht gefunden. Die angeforderte Seite existiert nicht oder wurde verschoben. Bitte prüfen Sie die Adresse oder kehren Sie zur Startseite zurück. Fehler.
Page introuvable. La page ou le document demandé n'existe pas, plus ou a été déplacé. Retour à l'accueil. Erreur sur le site.
Página no encontrada. La página, el recurso o el documento que busca o solicitado no existe o se ha movido. Volver al inicio. Error en el sitio.
Página não encontrada. A página ou o recurso que procura não existe ou foi movido. Erro: não pôde ser carregada, servidor.
Pagina non trovata. La pagina richiesta non esiste. Errore.
Страница не найдена. Запрошенная страница не существует или была удалена. Ошибка. Вернуться на главную.
ページが見つかりません。お探しのページは存在しないか、移動または削除されました。エラー
抱歉，您访问的页面不存在或已被删除。找不到页面，错误。返回首页。请求的资源未找到
페이지를 찾을 수 없습니다. 요청하신 페이지가 존재하지 않습니다. 오류
topic = access
Access denied. You do not have permission, access or authorization to view, read, open or access this page, document, resource or directory on this server. Error code. Contact the administrator.
403 Forbidden. 401 Unauthorized. Not authorized, not allowed, refused. HTTP status error. Authentication or authorization is required.
Please log in or sign in to continue, view or read the full text, or to access this content. Your session has expired or timed out; sign in or log in again, once more, and reload. Invalid username or password. You have been logged or signed out. Register or create an account.
Subscription, purchase or institutional access required to read the full article. Get access, buy, rent, check access, log in via your institution.
Zugriff verweigert. Sie haben keine Berechtigung, diese Seite aufzurufen. Fehlercode. Bitte melden Sie sich an. Anmelden erforderlich.
Accès refusé, interdit. Vous n'avez pas l'autorisation d'accéder à cette page. Veuillez vous connecter.
Acceso denegado. No tiene permiso para acceder a esta página. Inicie sesión.
Acesso negado. Você não tem permissão para acessar esta página.
Доступ запрещён. У вас нет прав для просмотра этой страницы. Войдите.
访问被拒绝。您没有权限访问此页面。请登录
topic = server
500 Internal Server Error. 502 Bad Gateway. 503 Service Unavailable. 504 Gateway Timeout. 429 Too Many Requests. 400 Bad Request. HTTP status error. nginx, Apache Server at port.
The server encountered an internal or unexpected error and was unable to complete, handle, process or serve your request. Please try again later or contact support. It has been logged, reported; we are working on it, apologise for the inconvenience.
The service or site is temporarily unavailable, overloaded, or down for maintenance, scheduled maintenance; we'll be back soon, shortly, at. Capacity problems; upgrading.
Something went wrong, sorry, an error occurred, has occurred. Unable to load or display this content right now, at this time. It is not available. Refresh or reload the page. Whoops, failed, retry. An unexpected application, fatal, runtime, client error or incident.
Rate limit exceeded, retry in seconds. Too many requests from this address, slow down. Quota. Limit reached.
Error establishing a database connection. Connection refused, closed, reset, lost, failed or timed out. The connection to the host timed out after ms. Upstream connect error or disconnect before headers. No response; unreachable, offline. Check your internet or network.
SSL certificate problem while contacting. Your connection is not private or secure. Invalid, expired certificate; handshake failed. DNS name lookup could not be resolved.
Dienst nicht verfügbar. Interner Serverfehler. Bitte versuchen Sie es später erneut. Wartungsarbeiten.
Service indisponible. Erreur interne du serveur. Veuillez réessayer plus tard. Maintenance.
Servicio no disponible. Error interno del servidor. Inténtelo de nuevo más tarde. Mantenimiento.
Внутренняя ошибка сервера. Сервис временно недоступен. Попробуйте позже.
服务器内部错误，服务暂时不可用，请稍后再试。系统维护中
topic = code
TypeError: Cannot read property or properties of undefined or null (reading abstract). undefined is not a function, object or defined. ReferenceError.
SyntaxError: Unexpected token or end of JSON input at position. Failed to fetch, parse, execute. line column
function(){return this.abstract} var let const window document getElementById innerHTML onload push new Date true false
Fatal error: Uncaught exception, Error: Call to undefined function. Warning: mysqli_connect(), include, require: failed to open stream: no such file or directory in /var/www/html/db.php on line. mysqli_connect(): Connection refused. Notice: Undefined index or variable. Stack trace thrown db inc
java.lang.NullPointerException at org.render main thread. Exception in thread. Caused by. at com java servlet. ArrayIndexOutOfBoundsException, ClassNotFoundException
Traceback (most recent call last): File line in module. KeyError, ValueError, NameError, AttributeError: object has no attribute. Internal exception py
undefined
null
NaN
[object Object]
[object HTMLDivElement] HTMLElement
#REF!
#N/A
#VALUE!
#NAME? #DIV/0!
nil None
topic = furniture
Share, cite, download, print, email, save, export citation, permissions, add to favourites, follow, alerts, metrics, tools, references, related, figures, tables. Toggle navigation.
Skip to main content. Menu, search, sign in, log in, register, cart, basket, account, help, subscribe, journals, books, browse, submit, about us, contact, home, login, news, archive, current issue. Open or close menu.
Twitter, Facebook, LinkedIn, Reddit, WeChat, copy link, back to top, next, previous, article, view, PDF, full text, show more, read more, expand, collapse, terms, conditions, privacy, all rights reserved.
topic = loading
Loading. Please wait while we load, fetch, get, retrieve or prepare the page, content, abstract or article. Loading abstract, one moment, hold on, this may take a few seconds. Redirecting. Processing your request. Please stand by.
Laden. Bitte warten. Chargement en cours, veuillez patienter. Cargando, espere por favor. Carregando, aguarde. Загрузка, подождите. 加载中，请稍候。読み込み中です。お待ちください
topic = placeholder
Abstract goes here. Your abstract here. Insert, add, enter, type, paste, write or put the abstract, summary, text or description of your paper, article or manuscript in this box, field, area, section or space. Click or tap here to enter, add or edit text. Replace this text with your own.
Your abstract text (max. words). Maximum or minimum characters. Abstract should be no more, fewer or longer than words. Limit.
Sample, dummy, example, placeholder or test abstract for record, article. Do not publish, ignore, delete, remove. This is a test, only, just testing.
To be added, announced, determined, completed, supplied, provided or written later. TBD TBA TODO FIXME: add abstract. Coming soon. Pending, forthcoming, under construction. Abstract to follow.
abstract abstract abstract text text title title content description summary
test. test test. test test test testing
xxx xxx xxx
asdf qwerty foo bar baz blah
Hier steht Ihre Zusammenfassung. Zusammenfassung hier einfügen, eingeben. Text folgt. Platzhalter
Insérez votre résumé ici. Saisissez, ajoutez le texte du résumé. Résumé à venir
Inserte aquí el resumen del artículo. Escriba, añada su texto. Resumen pendiente
Insira aqui o resumo do artigo. Digite, escreva seu texto. Resumo pendente
Inserire qui il riassunto, abstract dell'articolo. Testo
Вставьте сюда аннотацию, текст. Аннотация будет добавлена позже. Введите
在此处输入摘要。请填写文章摘要内容。摘要待添加
ここに要旨を入力してください。抄録、概要、準備中
여기에 초록을 입력하세요. 초록 내용
topic = filler
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
"""
#: Containment of a window in its exemplar, and of the exemplar in the window.
CONTAINED, COMPLETE = 0.55, 0.6
#: Containment of a window in the wording of a topic, and its least mass in tokens that are as rare as an unknown one.
IN_TOPIC, TOPIC_MASS = 0.6, 1.5
#: Most words (or pairs of characters of scripts without spaces) beside the residue that still count as a title.
TITLE_WORDS = 60
#: Coverage from which a text counts as residue.
COVERED = 0.8
NOT_AVAILABLE = ("", "n/a", "na", "none", "-")

_PLACE = re.compile(
    r"\{\{.*?\}\}|\$\{.*?\}|#\{.*?\}|<%.*?%>|\{%.*?%\}|\[\[.*?\]\]|@@\S+?@@|__[\w.]+?__|<\?(?:php)?.*?\?>|%%\S+?%%", re.S | re.I
)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_SITE = re.compile(r"\b(?:https?://)?(?!(?:java|javax|org|com|net)\.)[\w-]+(?:\.[\w-]+)*\.(?:[a-z]{2,})\b(?:/\S*)?", re.I)
_TOKEN = re.compile(r"\x01|[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|#[A-Z/]+!?", re.I)
_IDENT = re.compile(r"\b(?=\w*\d)[0-9a-f]{6,}\b", re.I)
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힣฀-๿]")


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Tokens with their places in the prepared text; numbers, identifiers and host names leave none."""
    out = []
    for m in _TOKEN.finditer(text):
        word = m[0].lower()
        if word[0].isdigit():
            continue
        if _WIDE.match(word):
            out += [(word[i : i + 2], m.start() + i, m.start() + i + 1) for i in range(max(1, len(word) - 1))]
        else:
            if len(word) > 2 and set(word) == {"x"}:
                word = "xxx"
            out.append((word, m.start(), m.end()))
    return out


def words_of(text: str) -> list[str]:
    """The tokens without their places."""
    found = [m.lower() for m in _TOKEN.findall(text)]
    found = ["xxx" if w[:3] == "xxx" and set(w) == {"x"} else w for w in found if not w[0].isdigit()]
    if not _WIDE.search(text):
        return found
    return [part for w in found for part in ([w[i : i + 2] for i in range(max(1, len(w) - 1))] if _WIDE.match(w) else (w,))]


def prepare(text: str) -> str:
    """Entities resolved; placeholders, tags, host names and identifiers replaced by marks or blanks."""
    text = html.unescape(html.unescape(text)) if "&" in text else text
    text = unicodedata.normalize("NFKC", text)
    if any(c in text for c in "{<[@_$#%"):
        text = _PLACE.sub(" \x01 ", text)
        text = _TAG.sub(" \x01 " if not re.search(r"\w", _TAG.sub("", text)) else " ", text)
    return _SITE.sub(" ", _IDENT.sub(" ", text))


class Index:
    """Inverted index of the exemplars with the weights of their tokens.

    Each exemplar is posted only under its heaviest tokens, as many as make up more than 1 - COMPLETE of its mass: a
    window that holds COMPLETE of the mass holds one of these.
    """

    def __init__(self, frequency: dict[str, int], n: int) -> None:
        self.n, self.frequency = max(n, 1), frequency
        self.other = math.log(1 + self.n / (1 + max(1, self.n // 50)))
        self.exemplars: list[dict[str, int]] = [{"\x01": 0}]
        self.lengths = [1]
        topics: list[set[str]] = []
        for line in EXEMPLARS.strip().splitlines():
            if line.startswith("topic ="):
                topics.append(set())
                continue
            for sentence in re.split(r"(?<=[.!?。！？])\s*", line):
                words = [w for w, _, _ in tokens(prepare(sentence))]
                if words and words != ["\x01"]:
                    topics[-1].update(words)
                    self.exemplars.append({w: i for i, w in reversed(list(enumerate(words)))})
                    self.lengths.append(len(words))
        self.known = {w: 0.3 + math.log(1 + self.n / (1 + frequency.get(w, 0))) for e in self.exemplars for w in e}
        self.mass = [sum(map(self.known.get, e)) for e in self.exemplars]
        self.postings: dict[str, list[int]] = defaultdict(list)
        for k, e in enumerate(self.exemplars):
            held = 0.0
            for w in sorted(e, key=lambda w: (-self.known[w], w)):
                self.postings[w].append(k)
                held += self.known[w]
                if held > (1 - COMPLETE) * self.mass[k]:
                    break
        # a topic is looked at only where one of its rare words occurs
        self.topics = topics
        self.rare: dict[str, list[int]] = defaultdict(list)
        for k, topic in enumerate(topics):
            for w in sorted(topic):
                if self.known[w] >= self.other:
                    self.rare[w].append(k)

    def covered(self, found: list[tuple[str, int, int]]) -> list[bool]:
        """For each token, whether a residue window holds it."""
        words = [w for w, _, _ in found]
        weights = [self.known.get(w, self.other) for w in words]
        cover = [False] * len(words)
        tried: set[tuple[int, int]] = set()
        for i, w in enumerate(words):
            for k in self.postings.get(w, ()):
                exemplar, size = self.exemplars[k], self.lengths[k]
                for start, width in ((i - exemplar[w], size), (i - exemplar[w] - size // 3, size + 2 * max(1, size // 3))):
                    begin, end = max(0, start), min(len(words), start + width)
                    while begin < end and words[begin] not in exemplar:
                        begin += 1
                    while end > begin and words[end - 1] not in exemplar:
                        end -= 1
                    if begin >= end or (k, begin << 32 | end) in tried:
                        continue
                    tried.add((k, begin << 32 | end))
                    mine = sum(weights[begin:end])
                    inside = sum(wt for x, wt in zip(words[begin:end], weights[begin:end], strict=True) if x in exemplar)
                    if inside < CONTAINED * mine:
                        continue
                    if sum(self.known[x] for x in set(words[begin:end]) if x in exemplar) >= COMPLETE * self.mass[k]:
                        cover[begin:end] = [True] * (end - begin)
                        break
        for k in sorted({k for w in words for k in self.rare.get(w, ())}):
            for begin, end in self.best_windows(words, weights, k):
                cover[begin:end] = [True] * (end - begin)
        return cover

    def best_windows(self, words: list[str], weights: list[float], k: int) -> list[tuple[int, int]]:
        """The windows that a topic's wording contains best: stretches with the greatest surplus of its mass over the
        share that foreign words may have, which hold two rare words of the topic (one, if they are all of the text)
        and enough mass."""
        topic, out = self.topics[k], []
        fine = IN_TOPIC / (1 - IN_TOPIC)
        at = 0
        while at < len(words):
            if words[at] not in topic:
                at += 1
                continue
            gain = best = 0.0
            end = at
            for j in range(at, len(words)):
                gain += weights[j] if words[j] in topic else -weights[j] * fine
                if gain < 0:
                    break
                if gain > best:
                    best, end = gain, j + 1
            held = {w for w in words[at:end] if w in topic}
            rare = sum(k in self.rare.get(w, ()) for w in held)
            if sum(self.known[w] for w in held) >= TOPIC_MASS * self.other and (rare > 1 or rare and end - at == len(words)):
                out.append((at, end))
            at = max(end, at + 1)
        return out

    def hopeless(self, words: list[str]) -> bool:
        """Whether so many words are foreign to the index that no windows can cover the text but for a title.

        A window's foreign mass is at most (1 - CONTAINED) / CONTAINED of its known mass, and windows that cover a text
        can be chosen so that no token lies in more than two.
        """
        held = [self.known[w] for w in words if w in self.known]
        known, foreign = sum(held), len(words) - len(held)
        bare = foreign - 2 * (1 - CONTAINED) / CONTAINED * known / self.other
        return bare > max(TITLE_WORDS, (1 - COVERED) * len(words))

    def score(self, text: str | None) -> float:
        """Share of the text that residue covers, 1.0 if nothing but a title is beside it; 0.0 for no residue."""
        if text is None or text.strip().lower() in NOT_AVAILABLE:
            return 0.0
        ready = prepare(text)
        words = words_of(ready)
        if not words:
            return 1.0 if "\x01" in ready else 0.0
        if not any(w in self.postings or w in self.rare for w in words) or self.hopeless(words):
            return 0.0
        found = tokens(ready)
        cover = self.covered(found)
        if not any(cover):
            return 0.0
        rest = [f for f, c in zip(found, cover, strict=True) if not c]
        share = 1 - len(rest) / len(found)
        if not rest:
            return 1.0
        if len(rest) > TITLE_WORDS:
            return share * 0.5
        # what is left must be one run beside the residue, a title: before it, or after it where the residue is the larger part
        held = [i for i, c in enumerate(cover) if c]
        first, last = held[0], held[-1]
        before = not any(cover[i] for i in range(len(found)) if i > last) and len(rest) == first
        after = first == 0 and len(rest) == len(found) - 1 - last and share >= 0.4
        title = ready[: found[first][1]] if before else ready[found[last][2] :]
        if (before or after) and not re.search(r"[.!?。！？।؟](?:\s|$)", title.strip(" .…\n")) and not re.search(r"[.!?。！？।]\s*$", title.rstrip("…") if before else ""):
            return 1.0
        return share if share >= 0.8 else share * 0.5


def vocabulary() -> list[str]:
    """All tokens of the exemplars."""
    return sorted({w for words in Index({}, 1).exemplars for w in words if w != "\x01"})


def frequencies(df: DataFrame, text: str) -> tuple[dict[str, int], int]:
    """In how many texts of the whole column each token of the exemplars occurs (a bounded result), and how many there are."""
    words = F.concat(F.split(F.lower(F.col(text)), r"[^\p{L}]+"), F.array(F.lit("")))  # the empty one counts the texts
    kept = df.where(F.col(text).isNotNull()).select(F.explode(F.array_distinct(words)).alias("w")).where(F.col("w").isin("", *vocabulary()))
    counts = {r["w"]: r["n"] for r in kept.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return counts, counts.pop("", 0)


def residue_scores(df: DataFrame, key: str, text: str, least: float = COVERED) -> DataFrame:
    """One row (key, `coverage`) per text whose residue coverage is at least `least`."""
    counts, n = frequencies(df, text)
    kind = dict(df.dtypes)[key]
    held: list[Index] = []

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Index(counts, n))
        scores = [held[0].score(t) for t in batch.column(1).to_pylist()]
        keep = [i for i, s in enumerate(scores) if s >= least]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([scores[i] for i in keep], pa.float64())], ["k", "coverage"]
        )

    chosen = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return arrow_map(chosen, kernel, f"k {kind}, coverage double").withColumnRenamed("k", key)
