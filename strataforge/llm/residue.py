"""Template residue, filler, error pages and script notices in place of text.

Unfilled placeholders are found by one grammar per kind of delimiter; a
sentence that explains templates, or code, is discounted by its context and by
how little of it is placeholders. Messages are whole lines or sentences, found in
two ways: by grammars anchored at both ends, and by density, when a core phrase of
an error page stands among words that such pages are made of and hardly any
others. A sentence that only speaks of such things has words of its own. Filler is
decided by sets of words. Everything is a built-in expression of one scan: no
shuffle, no Python. Every line and sentence is tested, whatever its length; no
expression backtracks over a run or recurses with the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: words and phrases ----------------------------------------

#: What a field in plain square brackets is called.
FIELDS = "name first_name last_name full_name user username user_name customer customer_name client company organization email e_mail phone address street city state country zip date time day month year title subject heading headline summary description content body text message link url image author product item order order_id id number amount total price currency count quantity code"
LOREM = "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
LOREM_ONLY = "lorem ipsum consectetur consectetuer adipiscing eiusmod incididunt"
REASONS = [
    "bad request", "unauthorized", "payment required", "forbidden", "(?:page |file )?not found", "method not allowed", "not acceptable", "proxy authentication required", "request time-?out", "conflict", "gone", "length required", "precondition failed", "payload too large",
    "request entity too large", "uri too long", "unsupported media type", "expectation failed", "unprocessable (?:entity|content)", "locked", "upgrade required", "too many requests", "internal server error", "not implemented", "bad gateway", "service (?:temporarily )?unavailable", "gateway time-?out",
    "http version not supported", "insufficient storage", "loop detected", "network authentication required",
]
FILLERS = [
    "(?:your|insert|add|enter|type|place|put) (?:your )?(?:own )?(?:text|content|copy|title|heading|description|caption)(?: (?:goes |comes )?here)?", "(?:text|content|copy|title|heading|description|body copy|body text) goes (?:here|in this box)", "this is (?:a )?(?:placeholder|dummy|sample|filler)(?: (?:text|paragraph|content|title|page|post|website))?", "(?:write|type|put) something here", "replace (?:it|this|this text) with your own (?:text|content|copy)",
    "click here to (?:edit|add|change)(?: (?:this|your))? (?:text|content|title)", "(?:dummy|sample|filler|placeholder|example) (?:text|content|copy|paragraph)", "placeholder", "untitled(?: (?:document|page|post))?", "add (?:a|your) (?:description|title|caption|subtitle)", "(?:page |content )?(?:coming soon|under construction)", "tbd|tba|tbc|n/a|todo|fixme|xxx+",
    "(?:todo|fixme|tbd)[:!-] ?.{0,80}", "hier steht ihr text", "hier (?:kommt|steht) (?:der|ihr|dein) text(?: hin)?", "blindtext|platzhalter(?:text)?|mustertext|beispieltext", "texte? (?:à|a) compl[ée]ter|texte (?:de remplissage|d'exemple|ici)|votre texte ici|faux[- ]texte", "texto de (?:ejemplo|relleno|prueba|exemplo)|(?:su|tu|seu) texto (?:aquí|aqui)", "текст-заполнитель|пример текста|ваш текст здесь|введите текст|текст-рыба|здесь будет (?:ваш )?текст",
    "(?:przykładowy|tutaj) tekst|tekst zastępczy|wpisz tekst", "testo (?:di esempio|segnaposto)|inserisci (?:il )?testo(?: qui)?", "örnek metin|buraya metin (?:girin|gelecek)", "κείμενο (?:εδώ|παράδειγμα)|δείγμα κειμένου", "नमूना पाठ|यहाँ (?:अपना )?पाठ लिखें", "no (?:title|description|content)(?: (?:available|provided))?", "\\[?(?:text|content) missing\\]?",
]
ERRORS = [
    "oops|ooops|whoops", "(?:oops,? |sorry,? )?something went wrong", "(?:please )?try again later|please try again", "an? (?:unexpected |unknown |internal |server )?error (?:has )?occurred", "access denied|permission denied", "you (?:do not|don't) have (?:permission|access) to (?:access |view |open )?.{1,60}", "(?:too many requests|slow down)", "slow down and reload in \\d+ seconds",
    "(?:error \\d{3} ?[-:|] ?)?(?:the |this )?(?:requested )?(?:page|url|file|resource)(?: (?:you (?:are|were) looking for|you requested|requested))? (?:could not be found|was not found|cannot be found|not found|does not exist|doesn't exist|is not available|is unavailable|has been (?:moved|removed|deleted))(?: on this server| or has been (?:moved|removed|deleted)| anymore)?",
    "we are (?:currently )?(?:down|offline|closed) for (?:scheduled )?maintenance", "(?:this |the |our )?(?:site|website|page|service|server)? ?(?:is )?(?:currently |temporarily )?(?:down|undergoing|under|offline for) (?:for )?(?:scheduled )?maintenance", "(?:scheduled |site )maintenance(?: in progress)?", "(?:we will|we'll) be (?:right )?back (?:soon|shortly)",
    "(?:your )?session (?:has )?(?:expired|timed out)", "(?:please )?log ?in again", "please (?:log|sign) in (?:again )?to (?:continue|view .{1,40})", "(?:the )?(?:request|connection|operation) (?:has )?timed out(?: \\(?(?:error |code )?\\d+\\)?)?", "(?:gateway time-?out|bad gateway|service unavailable|internal server error)(?: ?[:-] ?.{1,60})",
    "(?:error (?:establishing|connecting to) )?(?:a )?(?:database|server) (?:connection|error)(?: (?:failed|refused|lost|error))?", "(?:could not|cannot|can't|failed to|unable to) connect to (?:the )?(?:database|server)", "connection (?:refused|reset|failed)", "(?:php )?(?:fatal|parse|syntax|runtime) error ?: .{1,160}", "(?:php )?(?:warning|notice) ?: .{1,120} on line \\d+", "traceback \\(most recent call last\\):?.{0,160}", "(?:uncaught |unhandled )?(?:\\w+error|\\w*exception)(?: ?: .{1,120}| in .{1,80})",
    "seite (?:wurde )?nicht gefunden|(?:die )?(?:angeforderte )?seite (?:existiert|konnte) nicht(?: gefunden werden)?|zugriff verweigert|(?:interner )?serverfehler|ein fehler ist aufgetreten|bitte versuchen sie es später (?:erneut|noch einmal|wieder)|(?:wegen )?wartungsarbeiten|ihre sitzung ist abgelaufen", "page (?:introuvable|non trouvée|inexistante)|(?:la )?page demandée (?:est introuvable|n'existe pas)|accès (?:refusé|interdit)|erreur (?:interne )?du serveur|une erreur (?:est survenue|s'est produite)|veuillez réessayer(?: plus tard)?|(?:site )?en maintenance|votre session a expiré",
    "página no encontrada|(?:la )?página (?:solicitada )?no existe|acceso denegado|error interno(?: del servidor)?|(?:se ha producido|ha ocurrido|ocurrió) un error|(?:por favor,? )?inténtelo (?:de nuevo )?más tarde|(?:sitio )?en mantenimiento|su sesión ha (?:expirado|caducado)", "страница не (?:найдена|существует)|доступ (?:запрещ[её]н|закрыт)|внутренняя ошибка(?: сервера)?|(?:произошла|возникла) ошибка|ошибка сервера|(?:пожалуйста, )?(?:попробуйте|повторите) (?:попытку )?(?:позже|снова)|(?:сайт )?на (?:техническом )?обслуживании|ведутся технические работы|сессия истекла|время сессии истекло",
    "nie znaleziono (?:takiej )?strony|strona nie (?:została znaleziona|istnieje)|odmowa dostępu|brak dostępu|wewnętrzny błąd serwera|błąd serwera|wystąpił błąd|przerwa techniczna|spróbuj ponownie później", "pagina non trovata|accesso negato|errore interno(?: del server)?|si è verificato un errore|sito in manutenzione|página não encontrada|acesso negado|erro interno do servidor", "sayfa bulunamadı|erişim (?:reddedildi|engellendi)|sunucu hatası|bir hata oluştu|bakım çalışması", "η σελίδα δεν βρέθηκε|δεν βρέθηκε η σελίδα|σελίδα δεν βρέθηκε|δεν επιτρέπεται η πρόσβαση|σφάλμα διακομιστή|παρουσιάστηκε σφάλμα",
    "पृष्ठ नहीं मिला|पेज नहीं मिला|सर्वर त्रुटि|आंतरिक सर्वर त्रुटि|पहुँच अस्वीकृत", "ページが見つかりません(?:でした)?|アクセスが拒否されました|サーバーエラー|页面(?:不存在|未找到)|找不到页面|访问被拒绝|服务器错误|الصفحة غير موجودة|تم رفض الوصول|خطأ في الخادم",
]
_JS = "(?:java ?script|js|scripts?|scripting|cookies?)(?:(?: and | & |/| or )(?:java ?script|js|scripts?|cookies?))?"
NOTICES = [
    f"(?:please |you (?:need|must|have|will need)(?: to)? |kindly )?(?:enable|activate|allow|turn on|switch on|accept) {_JS}(?: (?:in|to|and|for|on|then)\\b.{{0,80}}| support.{{0,60}})?", f"(?:this|the|our) (?:site|page|app|website|web ?site|application|document|content|form|video|player|feature) (?:requires|needs|uses|relies on|works best with|will not work without|does not work without) {_JS}(?: .{{0,60}})?",
    f"(?:your|the) browser (?:does not|doesn't|must|cannot|can't|has to) (?:support|run|execute|allow|accept|have) {_JS}(?:[ ;,].{{0,80}})?", f"(?:your browser has )?{_JS} (?:is|are|must be|appears? to be|seems? to be|has been|have been)(?: currently)? (?:required|disabled|turned off|blocked|not (?:enabled|supported|available)|needed|enabled|switched off|off)(?: .{{0,80}})?", f"(?:we (?:have )?detected that )?{_JS} (?:is|are) (?:disabled|blocked|turned off).{{0,80}}",
    "turn them on and (?:reload|refresh|try again)(?: .{0,30})?", "checking (?:your browser|if the site connection is secure)(?: .{0,60})?", "(?:please )?(?:verify|confirm) (?:that )?you are (?:a )?human(?: .{0,60})?", "you need to enable .{1,20} to run this app", f"to (?:view|use|see|continue|access|read) .{{0,50}},? (?:please )?(?:enable|activate|turn on|allow) {_JS}(?: .{{0,40}})?", f"sorry,? (?:but )?(?:this|the) (?:site|page) (?:requires|needs) {_JS}.{{0,40}}",
    "(?:bitte )?(?:aktivieren|erlauben|schalten) sie (?:bitte )?(?:java ?script|cookies|skripte)(?:[ ,].{0,80})?|(?:java ?script|cookies) (?:ist|sind|muss|müssen) (?:deaktiviert|erforderlich|aktiviert).{0,60}|(?:diese|die) seite (?:benötigt|erfordert) (?:java ?script|cookies).{0,60}|ihr browser unterstützt (?:kein java ?script|keine skripte).{0,60}", "(?:veuillez|merci d'|vous devez) ?(?:activer|autoriser|accepter) (?:le )?(?:java ?script|les cookies|les scripts)(?: .{0,80})?|(?:java ?script|les cookies) (?:est|sont) (?:désactivés?|requis|nécessaires?).{0,60}|(?:ce site|cette page) (?:nécessite|requiert) (?:java ?script|des cookies|les cookies).{0,60}|votre navigateur ne (?:supporte|prend) pas .{0,60}",
    "(?:por favor,? )?(?:active|activa|habilite|habilita|debe activar|permita) (?:el )?(?:java ?script|las cookies|los scripts)(?: .{0,80})?|(?:java ?script|las cookies) (?:está|están) (?:desactivado|deshabilitado|desactivadas).{0,60}|(?:este sitio|esta página) (?:requiere|necesita) (?:java ?script|cookies).{0,60}|su navegador no (?:admite|soporta) .{0,60}", "(?:для (?:просмотра|работы|продолжения|отображения).{0,40} )?(?:пожалуйста, )?(?:включите|разрешите|требуется|необходим|необходимо включить|активируйте) (?:поддержку )?(?:java ?script|cookies|файлы cookie|скрипты)(?: .{0,60})?|(?:java ?script|cookies) (?:отключ[её]н|отключены|выключен|требуется).{0,60}|ваш браузер не поддерживает .{0,60}",
    "(?:proszę )?(?:włącz|włączyć|zezwól na) (?:obsługę )?(?:java ?script|cookies|pliki cookie|skrypty)(?:[ ,].{0,60})?|(?:aby .{1,50}, )?(?:włącz|włączyć) java ?script.{0,40}|twoja przeglądarka nie obsługuje .{0,60}|(?:ta )?strona wymaga (?:java ?script|cookies|plików cookie).{0,40}", "(?:per favore,? |si prega di )?(?:attiva|abilita|attivare|abilitare) (?:i )?(?:java ?script|cookie)s?(?: .{0,60})?|(?:por favor,? )?(?:ative|habilite) (?:o |os )?(?:java ?script|cookies)(?: .{0,60})?", "(?:lütfen )?(?:.{0,40} için )?(?:java ?script|çerezleri)[^ ]{0,6} (?:etkinleştirin|açın).{0,30}", "(?:παρακαλώ )?(?:ενεργοποιήστε|ενεργοποίησε) (?:τη |την |το )?(?:java ?script|cookies).{0,60}|(?:για .{1,40} )?ενεργοποιήστε .{0,6}java ?script.{0,40}", "(?:कृपया |.{1,40} लिए )?(?:java ?script|जावास्क्रिप्ट|कुकीज़) (?:सक्षम|चालू) (?:करें|कीजिए).{0,20}", "(?:java ?script)を有効にして(?:ください)?.{0,30}|请启用 ?(?:java ?script|cookie).{0,30}|يرجى تفعيل (?:java ?script|جافا سكريبت).{0,40}",
]

# --- grammars ---------------------------------------------------------------

_NAME = r"[A-Za-z_][A-Za-z0-9_]*+"
_FIELD_UP = "(?:" + "|".join(FIELDS.upper().split()) + ")"
_HEAD = "(?:" + "|".join(x.title() for x in FIELDS.split() if "_" not in x and x not in ("organization", "country", "state", "city")) + ")"
_ASK = "(?i:insert|enter|add|your|type|choose|select|fill in)"
#: Names as programs write them: order_id, order.id, orderId.
_SHAPED = r"(?:[A-Za-z]++(?:[_.-][A-Za-z0-9]++)++|[A-Z]?[a-z]++(?:[A-Z][a-z0-9]*+)++)"
#: One grammar per delimiter.
PLACEHOLDERS = [
    r"\{\{[{~]?\s*+[#/^&>!~=]?\s*+[$@._A-Za-z][^{}]*+\}\}",  # {{ name }} {{#if user}} {{ items[0] }}
    rf"[$#%]\{{\s*+[!_A-Za-z][^{{}}]*+\}}",  # ${name} #{name} %{name}
    r"\{%[-+]?\s*+[A-Za-z][^{}%]*+%\}",  # {% name %}
    r"<%[=#@-]?\s*+[$@A-Za-z][^<>%]*+%>",  # <%= name %>
    r"<\?(?:php|=)?\s*+(?:echo )?\$[^<?]*+\?>",  # <?= $name ?>
    rf"\[\[\s*+{_NAME}(?:[ .]{_NAME})*+\s*+\]\]",  # [[first name]]
    rf"<<\s*+{_NAME}(?: {_NAME})*+\s*+>>|&lt;\s*+{_NAME}\s*+&gt;",  # <<name>> &lt;name&gt;
    rf"«(?:{_SHAPED})»|\*\|[A-Z][A-Z0-9_:]*+\|\*|\{{!\s*+{_NAME}(?:\.{_NAME})*+\}}",  # «FirstName» *|FNAME|* {!Contact.Name}
    rf"(?<![0-9%])%{_NAME}%(?![0-9A-Za-z%])|%%{_NAME}%%|%\({_NAME}\)[sdif]",  # %NAME% %%name%% %(name)s
    r"(?<![A-Za-z0-9_])__[A-Za-z][A-Za-z0-9]*+(?:_[A-Za-z0-9]++)*+__(?![A-Za-z0-9_])",  # __NAME__
    rf"@@{_NAME}@@|##{_NAME}##",  # @@name@@ ##name##
    rf"(?<![A-Za-z\\])\{{(?:[0-9]{{1,2}}|{_SHAPED}|[A-Za-z]++)\}}",  # {0} {order_id} {firstName} {name}
    rf"<[a-z]++(?:_[a-z]++)++>|<[a-z]++(?:[A-Z][a-z]++)++>|<{_ASK} [^<>]++>",  # <order_id> <your name>
    r"(?:^|[^0-9A-Za-z%])%(?:[0-9]\$)?[sd@](?:$|[^A-Za-z0-9_%])",  # %s %1$s
    rf"\[{_ASK} [^\[\]]++\]",  # [INSERT NAME HERE]
    rf"\[(?:{_FIELD_UP}|[A-Z]++(?:_[A-Z0-9]++)++|(?=[^\[\]]* (?:HERE|NAME|DATE|ADDRESS|NUMBER|TITLE)\])[A-Z ]++|(?:[A-Z][a-z]++ )++{_HEAD})\]",  # [NAME] [ORDER_ID] [Client Name]
]
PLACEHOLDER = "|".join(f"(?:{p})" for p in PLACEHOLDERS)
FENCE, INLINE, CODE_TAG = "```", r"`[^`\n]*+`", r"(?i)</?(?:code|pre)(?: [^<>]*+)?>"
TUTORIAL = r"(?i)\b(?:syntax|placeholders?|templat(?:e|ing) (?:language|engine|syntax)|tutorial|documentation|variables?|escaped?|is written as|angle signs|for example|e\.g\.|wiki\w*|markdown|notation|(?:curly|double|single) braces)\b"
#: Every placeholder holds one of these, so most texts need no grammar.
OPENERS = r"[{%<\[«]|__|@@|##|&lt;|\*\|"
#: Share of a tutorial sentence's words that may be placeholders.
TUTORIAL_DENSITY = 0.34

_CODE_NO = r"[1-5]\d\d"
_REASON = "(?:" + "|".join(REASONS) + ")"
_LABEL = r"http(?:/\d(?:\.\d)?)?(?: status| error)?|(?:server )?error(?: code)?|fehler|erreur|ошибка|błąd|hata|errore|erro|fout|fel|virhe|chyba|помилка|σφάλμα|त्रुटि|エラー|错误|خطأ|server responded with status|(?:the )?server returned(?: an)?(?: error| status)?"
_PREFIX = rf"(?:{_LABEL}|status(?: code)?|code)"
#: What stands below messages and says nothing.
TAIL = r"(?<![\p{L}\p{N}])(?:retry|back to home(?: ?page)?|go back|home|nginx(?:/[\d.]++)?|apache(?:/[\d.]++)?(?: server)?|cloudflare|reference:? #?[0-9a-z.-]++|request id:? #?[0-9a-f-]++|ray id:? [0-9a-f]++|(?:© |\(c\) )?all rights reserved)(?=$|[^\p{L}\p{N}])|© .{0,40}$"
STATUS = "|".join(
    [
        rf"(?:{_PREFIX}[ :]*+)?\(?{_CODE_NO}\)?[ :|=.–—-]*+{_REASON}",
        rf"{_REASON}[ :|–—-]*+\(?(?:{_PREFIX} ?)?{_CODE_NO}\)?",
        rf"code[=:] ?{_CODE_NO},? message[=:] ?{_REASON}",
        rf"(?:{_LABEL})[ :#]*+{_CODE_NO}",
        "(?:bad request|page not found|not found|request time-?out|too many requests|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)",
    ]
)
#: Labels of program output; whatever follows belongs to it.
OUTPUT = r"^(?:(?:php )?(?:fatal|parse|syntax|runtime) error ?:|(?:php )?(?:warning|notice) ?: .*+(?<=on line \d{1,6})$|traceback \(most recent call last\)|(?:uncaught |unhandled )(?:\w+error|\w*exception)|(?:[a-z_$]++\.)++\w*(?:exception|error):|(?:todo|fixme|tbd)[:!-] )"
_BODY = "|".join(f"(?:{x})" for x in [STATUS, *FILLERS, *ERRORS, *NOTICES])
#: A code after a message: "page introuvable (erreur 404)".
WHOLE = rf"^(?:{_BODY})(?: ?\((?:{_PREFIX} ?)?{_CODE_NO}\))?$"
#: A message of an error page names one of these; the rest of it is made of LEXICON.
CORE = (
    r"\b(?:not found|(?:is|'s) an error\b|being redirected|(?:request|access|connection) (?:blocked|denied|rejected)|(?:is|are|was|were)n't (?:currently |yet )?(?:available|working|responding)|(?:can ?not|can't|couldn't|could not|won't) (?:be|find|connect|load|open|display|access|process|complete|reach)\b|(?:does not|doesn't|do not|don't) (?:exist|have (?:permission|access))|no longer (?:exists?|available|here|active)|(?:not|un)(?: currently| temporarily)? ?available|unavailable|went wrong|errors? (?:has |have )?(?:occurred|happened)|(?:encountered|experiencing) (?:an?|some|technical|unexpected)\b|"
    r"access (?:to this \w+ )?(?:is |was |has been )?(?:denied|restricted|forbidden|blocked)|(?:have|has) been (?:blocked|banned|suspended|disabled|moved|removed|deleted|logged out|signed out|limited)|not (?:authori[sz]ed|allowed|permitted)|try again|timed out|took too long|too long to respond|refused (?:to connect|the connection)|unable to (?:connect|load|find|process|complete|access|display|reach|open|resolve)|failed to (?:load|connect|fetch|open|process|respond)|"
    r"internal (?:server )?error|server error|bad gateway|service unavailable|too many (?:requests|redirects|connections|attempts)|(?:rate|bandwidth|request|usage) limit|under (?:maintenance|construction)|(?:down|offline|closed) for|(?:performing|undergoing) \w*+ ?maintenance|back (?:soon|shortly|online)|check back|coming soon|session (?:has |is )?(?:expired|invalid|ended)|link (?:has |is )?(?:expired|invalid|broken)|(?:log|sign) in (?:to|again)|must be (?:logged|signed) in|"
    r"(?:enable|activate|allow|accept|requires?|needs?|support|without) (?:javascript|cookies|scripts?)|checking (?:your browser|if)|verify (?:that )?you(?: are|'re)|are (?:a )?human|not a robot|security check|please (?:wait|refresh|reload|enable)|invalid (?:request|url|token|session|address)|page (?:has|was|is|may|might|you)|nothing (?:was )?found|no results|just a moment|moved permanently|aw,? snap|quota exceeded|connection (?:was |has been )?(?:reset|refused|lost|closed|interrupted|failed)|lost connection)"
)
#: Scripts or cookies, and what is the matter with them.
SCRIPTS, STATE = r"\b(?:javascript|cookies|scripts?)\b", r"\b(?:enabled?|disabled|required|supported|off|on|blocked)\b"

# fixed values: the words that error pages and notices are made of
LEXICON = (
    "a about above access accessed accessing account accounts action active address administrator admin after again all allow allowed already also an and any anymore anything application app apologies apologize apologise are as at attempt attempts automatically available aw back bad bandwidth be because been been before being below blocked bookmark bookmarks broken browser browsers but button by cache can can't cannot captcha change check checked checking clear click close closed code come coming complete completed connect connected connecting connection connections construction contact content continue cookie cookies correct correctly could couldn't country current currently "
    "data database deleted denied details device did didn't different disable disabled disconnected display displayed dns do document does doesn't domain don't down due during either email enable enabled encountered ended entered entry error errors establish exceeded exist exists expected experiencing expired failed few file files find following for forbidden forgot found from full function gateway get give go gone had happened has have having he header help here hit home homepage hold host hostname how http https human i i'm id if in incorrect information internal internet interrupted into invalid ip is isn't issue issues it it's its "
    "javascript just know later latest let limit limited limitation link links load loaded loading location log logged login long longer looking looks lost made maintenance make making malfunction many may maybe message might minute minutes missing mistyped moment moments more moved must my name need needed needs network new no not nothing notified now occurred of off offline oh on once one online only oops open opened operation or order our out outage outdated overloaded owner page pages parameter password performing permanently permission permissions permitted please possible prevented previous private problem problems proceed process processed processing properly protected protection "
    "provider proxy quota rate ray reach reached redirect redirected redirects redirecting refresh refreshing refused region reload removed renamed report request requested requests require required requires reset resolve resolved resource respond responded responding response restricted result results retry return right robot run running safe scheduled script scripting scripts search searching second seconds security see seem seems sent server server's servers service services session shortly should sign signed site site's snap so software some something soon sorry spam still submit support supported suspended sure system take taking technical team temporarily temporary that that's the their them then there there's these they this those time timed timeout "
    "to token too took traffic trouble try trying turn turned type typed typing typo unable unauthorized unavailable under undergoing unexpected unfortunately unknown unless until unusual up update updates upgrade upgrading upstream url us use used user username using valid verify verified verifying version video view viewing visit visited visitor wait want was wasn't way we we'll we're we've web webpage website webmaster well went were what when where whether which while who whoops why will with within without won't working working works would wrong yet you you'll you're you've your yourself"
)
FOREIGN_CORE = r"\b(?:nicht (?:gefunden|verfügbar|erreichbar|vorhanden|geladen|geöffnet)|existiert nicht|fehler (?:ist )?aufgetreten|zugriff verweigert|n'existe (?:pas|plus)|introuvable|indisponible|pas (?:disponible|trouvé\w*|accessible)|erreur (?:est survenue|s'est produite|inattendue|interne)|accès refusé|no (?:existe|encontrad[ao]|está disponible|disponible|se (?:ha podido |pudo |puede )?(?:encontr|carg|acced)\w+)|(?:ha ocurrido|se ha producido|ocurrió|se produjo) un (?:error|problema)|acceso denegado|algo (?:ha salido|salió) mal|não (?:existe|encontrad[ao]|está disponível|foi (?:encontrad[ao]|possível))|ocorreu um (?:erro|problema)|non (?:esiste|trovat[ao]|è (?:disponibile|stata trovata|possibile))|si è verificato un (?:errore|problema))"
FOREIGN_LEXICON = (
    "der die das den dem ein eine einen es ist sind wurde wurden leider entschuldigung diese dieser dieses ihre ihrer ihr sie wir uns bitte seite webseite website datei adresse inhalt server dienst verbindung derzeit zurzeit momentan vorübergehend nicht gefunden verfügbar erreichbar vorhanden geladen geöffnet werden kann konnte mehr existiert aufgerufene angeforderte gesuchte fehler aufgetreten interner unerwarteter zugriff verweigert später erneut noch einmal versuchen versuchen zurück zur startseite auf in mit und oder zu "
    "la le les l une un du de des ce cet cette page site contenu fichier adresse serveur service vous votre nous cherchez recherchez demandez demandée demandé recherchée que qui est sont a été n'existe pas plus introuvable indisponible disponible trouvé trouvée accessible actuellement temporairement désolé désolés oups erreur survenue s'est produite interne inattendue accès refusé veuillez réessayer plus tard ou déplacée supprimée d'accueil accueil retour à "
    "el los las una por favor lo sentimos disculpe página sitio contenido archivo dirección servidor servicio usted busca buscas solicitada solicitado solicita que no existe existe ya está encontrada encontrado encontrar encontró cargar acceder ha podido pudo puede se disponible actualmente temporalmente error problema ocurrido producido ocurrió produjo interno inesperado acceso denegado algo salido salió mal inténtelo intente de nuevo otra vez más tarde o fue eliminada movida en este esta "
    "o os as um uma desculpe desculpa lamentamos site conteúdo arquivo endereço servidor serviço você procura procurada solicitada não encontrada encontrado disponível possível foi erro ocorreu inesperado tente novamente mais il lo gli pagina sito contenuto indirizzo richiesta cercata cercando stai che non esiste trovata trovato disponibile è stata siamo spiacenti spiacente ci dispiace si verificato errore problema riprova tardi"
)
#: Words of messages in other languages, for the first look only.
FOREIGN = (
    "gefunden existiert aufgetreten verfügbar erreichbar n'existe indisponible disponible erreur encontrado encontró problema ocorreu disponível trovato disponibile verificato uncaught unhandled text blindtext platzhalter mustertext beispieltext nicht verweigert serverfehler fehler wartungsarbeiten abgelaufen erforderlich aktiviert deaktiviert aktivieren erlauben schalten versuchen benötigt erfordert unterstützt texte faux introuvable trouvée inexistante refusé interdit erreur maintenance réessayer expiré activer autoriser accepter désactivés désactivé requis nécessaire nécessaires nécessite requiert navigateur texto encontrada existe denegado error mantenimiento inténtelo expirado caducado active activa habilite habilita activar permita requiere necesita navegador página "
    "текст заполнитель рыба найдена существует запрещён запрещен закрыт ошибка попробуйте повторите обслуживании работы истекла включите разрешите требуется необходим необходимо активируйте отключён отключен отключены выключен поддерживает tekst nie odmowa brak błąd przerwa spróbuj włącz włączyć zezwól obsługuje wymaga testo segnaposto trovata negato errore manutenzione attiva abilita attivare abilitare negado erro ative habilite não "
    "metin bulunamadı reddedildi engellendi hatası oluştu hata bakım etkinleştirin açın κειμένου κείμενο βρέθηκε επιτρέπεται σφάλμα ενεργοποιήστε ενεργοποίησε पाठ मिला त्रुटि अस्वीकृत सक्षम चालू الصفحة رفض خطأ تفعيل gevonden geweigerd fout bestaat hittades hittas nekad fel løydes fundet funnet nægtet nektet löydy löytynyt evätty virhe nenalezena nenalezeno odepřen chyba található megtagadva hiba găsită găsit interzis eroare знайдено знайдена заборонено помилка tìm ditemukan ditolak kesalahan"
)
MORE_ERRORS = [
    # Dutch, Swedish, Danish, Norwegian, Finnish, Czech, Hungarian, Romanian, Ukrainian, Vietnamese, Indonesian, Korean
    "(?:deze |de )?pagina (?:is )?niet gevonden|(?:deze |de )?pagina bestaat niet(?: meer)?|toegang geweigerd|er is (?:een fout opgetreden|iets (?:fout|mis)gegaan)|schakel (?:alstublieft )?(?:java ?script|cookies) in(?: .{0,60})?", "sidan (?:kunde inte hittas|hittades inte|finns inte)|åtkomst nekad|ett fel (?:har )?(?:uppstått|inträffat)|aktivera (?:java ?script|cookies)(?: .{0,60})?", "siden (?:blev|ble) ikke (?:fundet|funnet)|siden findes ikke|adgang nægtet|(?:der|det) (?:opstod|oppstod|har oppstått) en (?:fejl|feil)|ingen tilgang", "sivua ei (?:löydy|löytynyt)|pääsy (?:evätty|kielletty)|tapahtui virhe",
    "stránka (?:nebyla )?nenalezena|stránka nebyla nalezena|přístup odepřen|došlo k chybě|chyba serveru", "az? oldal nem található|a keresett oldal nem található|hozzáférés megtagadva|hiba történt", "pagina nu (?:a fost găsită|există)|acces interzis|a apărut o eroare", "сторінк[аиу] не (?:знайдено|знайдена|існує)|доступ заборонено|сталася помилка", "không tìm thấy trang|truy cập bị từ chối|đã xảy ra lỗi", "halaman tidak ditemukan|akses ditolak|terjadi kesalahan", "페이지를 찾을 수 없습니다|접근이 거부되었습니다|오류가 발생했습니다",
]
WHOLE = WHOLE.replace("^(?:", "^(?:" + "|".join(f"(?:{x})" for x in MORE_ERRORS) + "|", 1)
#: Text whose words are not set apart by blanks is always looked at.
UNSPACED = r"[぀-ヿ一-鿿가-힯]"
#: A line in which one of these stands may be a message.
CUES = sorted(
    {*FOREIGN.split(), *LOREM_ONLY.split()}
    | set(
        "request unauthorized payment forbidden found method acceptable authentication conflict gone length precondition payload uri url media expectation unprocessable locked upgrade requests error errors implemented gateway service http storage loop timeout time text content copy title heading description caption placeholder dummy sample filler example untitled subtitle soon construction tbd tba tbc todo fixme oops ooops whoops wrong again denied permission access down reload slow exist exists available unavailable moved removed deleted maintenance offline closed back expired timed log sign connection connect database server fatal "
        "parse syntax runtime warning notice traceback exception javascript java js script scripts scripting cookie cookies browser checking human robot enable app xxx na n code status blocked banned allowed authorized authorised permitted unable failed too limit invalid check wait refresh verify security redirects respond refused reached page site moment snap quota lost reset occurred happened encountered experiencing results permanently redirected redirecting write".split()
    )
)

DECORATION = "*#>|=~_•·.!?…:,;\"'“”«»–—- \t"
TAGS = r"(?i)</?(?:h[1-6]|p|div|b|i|em|strong|span|center|title|body|html|head|br|hr|li|ul|a|noscript)(?: [^<>]*+)?/?>"
INVISIBLE = r"[\p{Cf}]"
#: Runs of blanks and blanks other than one plain space.
BLANKS = r"[\s   -   　]{2,}+|[\t\x0b\x0c   -   　]"
BREAKS = r"[\n\r\x0b\x0c\u0085  ]+"
SENTENCE = r"(?<=[.!?…。！？।])[\s ]+"
NOT_WORD = r"[^\p{L}\p{M}\p{N}']+"
WORD_ENDS = r"[\s.,;:!?]+"
FIRST_WORD = r"^[^\s\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000.,;:!?]++"
#: Words of which repetition is speech, not filler.
SPEECH = "ha haha hah heh hehe hi ho no oh ah la na da ja very so bye knock hear there now well".split()
#: Share of words from outside the lexicon that a message may have; short ones have none.
OUTSIDE, SHORT_WORDS = 0.12, 9


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` (an array) with ``value`` computed once, however often it is named."""
    return F.flatten(F.transform(F.array(value), use))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` (a condition) with ``value`` computed once."""
    return F.exists(F.array(value), use)


def _odd_dropped(parts: Column) -> Column:
    """Text between pairs of marks cut out; what follows an unpaired mark stays."""
    kept = lambda parts: _once(F.size(parts), lambda n: F.filter(parts, lambda p, i: (i % 2 == 0) | (i == n - 1)))
    return F.array_join(_once(parts, kept), " ")


def shown_text(text: Column) -> Column:
    """``text`` without invisible characters and code (fences, backticks, code tags)."""
    plain = F.regexp_replace(text, INVISIBLE, "")
    fenced = F.when(plain.contains(FENCE), _odd_dropped(F.split(plain, FENCE))).otherwise(plain)
    # few texts have a mark of code at all
    return F.when(~text.contains("`") & ~text.contains("<"), plain).otherwise(_odd_dropped(F.split(F.regexp_replace(fenced, INLINE, " "), CODE_TAG)))


def _tidy(s: Column) -> Column:
    """Single blanks, straight apostrophes, no decoration at the ends."""
    return F.btrim(F.translate(F.regexp_replace(s, BLANKS, " "), "’", "'"), F.lit(DECORATION))


def _segments(shown: Column) -> Column:
    """Lines, sentences and the whole text, in lower case and without decoration at the ends."""

    def cut(lines: Column) -> Column:
        sentences = F.flatten(F.transform(lines, lambda s: F.split(s, SENTENCE)))
        # a message broken over lines; one line is the whole already
        whole = F.when(F.size(lines) > 1, F.array(F.array_join(lines, " ")))
        return F.concat(lines, sentences, F.coalesce(whole, F.array().cast("array<string>")))

    plain = F.when(shown.contains("<"), F.regexp_replace(shown, TAGS, "\n")).otherwise(shown)
    return F.array_distinct(F.transform(_once(F.split(F.lower(plain), BREAKS), cut), lambda s: F.btrim(s, F.lit(DECORATION))))


def _dense(s: Column) -> Column:
    """A core phrase among words of the lexicon; numbers and addresses do not count."""

    def made_of_it(words: Column) -> Column:
        n = F.size(words)
        strange = F.size(F.filter(F.array_except(words, _array(sorted({*LEXICON.split(), *FOREIGN_LEXICON.split()}))), lambda w: ~w.rlike("[0-9]") & (w != "")))
        return (n >= 2) & F.when(n < SHORT_WORDS, strange == 0).otherwise(strange <= OUTSIDE * n)

    return (s.rlike(CORE) | s.rlike(FOREIGN_CORE) | (s.rlike(SCRIPTS) & s.rlike(STATE))) & _let(F.split(F.regexp_replace(s, r"\S*[/@_.]\S*", " "), NOT_WORD), made_of_it)


def _lorem(s: Column) -> Column:
    """Nothing but words of the filler text, two at least."""

    def only(words: Column) -> Column:
        filled = F.filter(words, lambda w: w != "")
        return (F.size(filled) >= 2) & F.arrays_overlap(filled, _array(LOREM_ONLY.split())) & (F.size(F.array_except(filled, _array(LOREM.split()))) == 0)

    return _let(F.split(s, NOT_WORD), only)


def _repeats(s: Column) -> Column:
    """Nothing but one to three words over and over, three times at least.

    Numbers count only as one number over and over; a line of dots is its groups.
    Repeated interjections are speech.
    """

    def again(words: Column) -> Column:
        kinds = F.size(F.array_distinct(words))
        worded = F.element_at(words, 1).rlike(r"^[^0-9]*\p{L}") & (kinds <= 3) & (F.size(F.array_except(words, _array(SPEECH))) > 0)
        number = F.element_at(words, 1).rlike("^[0-9]+$") & (kinds == 1) & (F.length(F.element_at(words, 1)) >= 3)
        return (F.size(words) >= 3) & (F.size(words) >= 3 * kinds) & (worded | number) & (F.length(s) >= 6)

    return _let(F.filter(F.split(F.btrim(F.regexp_replace(s, TAIL, " "), F.lit(DECORATION)), WORD_ENDS), lambda w: w != ""), again)


def _often(s: Column) -> Column:
    """The first word stands in ``s`` three times; cheap, and decides most against repeats."""
    return _let(F.regexp_extract(s, FIRST_WORD, 0), lambda w: (w != "") & (F.length(F.replace(s, w, F.lit(""))) <= F.length(s) - 3 * F.length(w)))


def _message(s: Column) -> Column:
    bare = _let(F.btrim(F.regexp_replace(s, TAIL, " "), F.lit(DECORATION)), lambda b: b.rlike(WHOLE) | _lorem(b) | _dense(b))
    return s.rlike(OUTPUT) | bare


def _dots(line: Column) -> Column:
    """Three groups of dots or more and nothing else."""
    groups = F.filter(F.split(F.btrim(F.regexp_replace(F.lower(F.regexp_replace(line, TAGS, " ")), TAIL, " "), F.lit("* \t")), r"[\s*]+"), lambda g: g != "")
    return line.contains("...") & _let(groups, lambda g: (F.size(g) >= 3) & F.forall(g, lambda x: x.rlike(r"^\.{3,}+$")))


def is_message(text: Column) -> Column:
    """A line or sentence of ``text`` is filler, an error message or a notice."""

    cued = lambda s: F.arrays_overlap(F.split(s, NOT_WORD), _array(CUES)) | s.rlike(UNSPACED) | s.contains("exception:") | s.contains("error:")

    def test(segments: Column, some: Column) -> Column:
        return F.exists(segments, lambda s: (some & cued(s) & _let(_tidy(s), _message)) | (_often(s) & _let(_tidy(s), _repeats)))

    # most texts name nothing of the kind anywhere; only repeats are looked for in them
    found = _let(_segments(shown_text(text)), lambda segments: _let(cued(F.lower(text)), lambda some: test(segments, some)))
    return found | (text.contains("...") & F.exists(F.split(text, BREAKS), _dots))


def has_placeholder(text: Column) -> Column:
    """An unfilled template field outside code and template tutorials."""
    sentences = F.flatten(F.transform(F.split(shown_text(text), BREAKS), lambda s: F.split(s, SENTENCE)))
    dense = lambda s: F.size(F.split(F.regexp_replace(s, PLACEHOLDER, "\x01"), "\x01")) - 1 >= TUTORIAL_DENSITY * F.size(F.split(s, r"\s+"))
    return text.rlike(OPENERS) & F.exists(sentences, lambda s: s.rlike(OPENERS) & s.rlike(PLACEHOLDER) & (~s.rlike(TUTORIAL) | dense(s)))


def residue(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``has_field`` and ``is_notice`` to ``docs``; null and empty texts have neither."""
    c = F.col(text)
    return docs.withColumns({"has_field": F.coalesce(has_placeholder(c), F.lit(False)), "is_notice": F.coalesce(is_message(c), F.lit(False))})


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` to be excluded, all columns kept.

    Repeated rows stay repeated, null ids stay; an empty table gives none.
    """
    return residue(docs, text).where(F.col("has_field") | F.col("is_notice")).drop("has_field", "is_notice")
