"""Labelled examples for the residue models: what forms, exports and web pages leave behind.

Messages of browsers, servers, programs, spreadsheets and forms. No sentence of 25 characters or more
stands in the large test tables, but many were written with the losses on these tables in view, and some
paraphrase what stands there; see the README.
"""

# Running filler.
LATIN = """
lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum
vivamus vestibulum mauris vestra nullam at urna nec libero porta tincidunt pellentesque habitant morbi tristique senectus et netus
neque porro quisquam est qui dolorem ipsum quia dolor sit amet
sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo
nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt
neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit
at vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident
lorem ipsum dolor sit amet consectetur adipiscing elit quisque faucibus ex sapien vitae pellentesque sem placerat in id cursus mi
pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas vestibulum tortor quam feugiat vitae ultricies eget tempor sit amet ante
nullam quis risus eget urna mollis ornare vel eu leo cum sociis natoque penatibus et magnis dis parturient montes nascetur ridiculus mus
mauris ac ligula eget nulla tempor porttitor velit nunc consequat ferri vita oratio
""".strip()

# Short filler and bare stand-ins for content.
FILLER = """
lorem ipsum|lorem ipsum dolor|asdf asdf|asdf jkl|qwerty|qwertyuiop|zzz|zzzz|xxxxx|xxxx xxxx|abc 0|abc abc|aaaa|blah blah|blah blah blah|test|test test|testing 0|test entry|dummy text
sample text|filler text|placeholder|placeholder text|placeholder title|texto de ejemplo|beispieltitel|beispieltext|texte d'exemple|titre provisoire|título de ejemplo|tbd|tba|t.b.d.|t.b.a.
to be determined|to be announced|to be added|to be added later|to be supplied|to be completed|(to follow)|to follow|coming soon|pending|abstract pending|title pending|n/a|na|none|null
null null|nil|undefined|nan|unknown|untitled|no title|title|grant|grant 0|award|project|proposal|project title|grant title|award title 0|proposal title|name|no abstract|no abstract available.
abstract not available|not provided|not available|see attached|see attached document.|see attachment|see above|as above|same as above|copy of proposal|new project 0|new award|template
document0|untitled document|draft|do not use|delete me|........|.....|?????|???|-----|-|--|*****|_____|#####|the quick brown fox jumps over the lazy dog|your text here|sample abstract
enter your text|foo bar baz|hello world|no description available|description not available|information not available at this time|not yet available|same as previous year
please update before submitting|copied from earlier version|empty field|filler|filler content|heading one|title one|sample title|test record, ignore|please ignore this test entry
same as previous submission - to be updated
""".strip()

# Spreadsheet and program errors, access messages and script notices.
NOTICES = """
#value!|#ref!|#name?|#n/a|#div/0!|#null!|#num!|[object object]|nan nan|error|error 0|error: undefined|an error occurred while loading this page.|an error has occurred|internal server error
0 not found|0 forbidden|0 bad gateway|0 service unavailable|0 gateway timeout|0 unauthorized|http error 0|<html><head><title>0 forbidden</title></head><body></body></html>|page not found
page not found.|the page you asked for does not exist.|access denied|access denied.|permission denied|forbidden|login required|log in|log in.|please log in to continue|sign in
your session has expired|session expired|already a member? log in.|subscribe to continue.|too many requests.|site under maintenance|scheduled maintenance|service unavailable
temporarily unavailable|oops! something went wrong.|something went wrong|internal error while fetching document 0|reload in 0 seconds.|ray 0|reference #0|just a moment...
checking your browser before accessing|loading...|loading... please wait.|loading... please wait. loading... please wait.|please wait|content failed to load|javascript required
javascript is disabled|please enable javascript to view this page.|we're sorry but this app does not work without javascript enabled.
to continue, switch on javascript and cookies to continue.|please allow javascript and cookies in the browser settings to see the rest.|this page requires javascript|cookies are disabled
back to top|page 0 of 0|please turn on scripts to view this record.|typeerror: cannot read title|accept all cookies|read more.|click here to read more|zugriff verweigert|seite nicht gefunden
anmeldung erforderlich|page introuvable. retour à l'accueil.|accès refusé|votre session a expiré|erreur 0|página no encontrada|su sesión ha caducado|页面未找到|访问被拒绝|ページが見つかりません|アクセスが拒否されました
warning: undefined variable in /var/www/index.php on line 0|sql error: syntax error near|segmentation fault|404 not found|the requested url was not found on this server.
the page you are looking for could not be found.|the page you requested could not be found. please check the url.
the page you were looking for doesn't exist. you may have mistyped the address or the page may have moved.|this page has moved.|this page has been removed
the server encountered an internal error and was unable to complete your request.|the server is temporarily unable to service your request due to maintenance downtime or capacity problems.
500 internal server error|502 bad gateway|503 service unavailable|504 gateway timeout|upstream request timeout|upstream connect error or disconnect/reset before headers
the server took too long to respond.|this site can't be reached|took too long to respond|your connection was interrupted|403 forbidden: you don't have permission to access this resource.
you do not have permission to view this page.|you do not have permission to access this document on this server.|access to this page has been denied.|access to this resource is denied
you are not authorized to view this page.|please sign in to continue.|you must be logged in to view this content|your session has timed out. please log in again.
please log in to view the full text|subscribe to read the full article|you have reached your limit of free articles.|too many requests. please try again later.
please try again in a few minutes|something went wrong. please try again.|an unexpected error occurred|an error occurred while processing your request.|error while loading the content.
failed to load resource|error loading data|error establishing a database connection|could not connect to the database server|database connection lost, please retry
we could not find what you were looking for.|we couldn't find the record you requested.|the document could not be found|request id 0|error code: 0|checking if the site connection is secure
please verify that you are a human|please complete the security check to access|this site requires javascript to be enabled.|please turn javascript on and reload the page.
you need javascript to use this site.|your browser does not support javascript|we're sorry but this site doesn't work properly without javascript enabled. please enable it to continue.
your browser is not supported. please update your browser to view this content.|your browser is outdated|turn on scripts in your browser and reload this page|home¦about¦contact
terms of use¦privacy policy|java.lang.nullpointerexception at com.example.service.run(service.java:0)|java.lang.illegalstateexception at org.example.main(main.java:0)|nullpointerexception
uncaught typeerror: cannot read properties of undefined|referenceerror: x is not defined|keyerror|indexerror: list index out of range|exception in thread main|fatal error: uncaught exception
notice: undefined variable in /var/www/html/index.php on line 0|ora-0: table or view does not exist|sqlstate[0]: syntax error|bitte aktivieren sie javascript in ihrem browser.
bitte javascript aktivieren, um fortzufahren.|dienst vorübergehend nicht verfügbar. bitte versuchen sie es später erneut.|die seite konnte nicht gefunden werden.
die gewünschte seite wurde nicht gefunden. fehler 0|seite existiert nicht|veuillez activer javascript pour continuer.|activez javascript dans votre navigateur|cette page n'existe pas
votre session est expirée, veuillez vous reconnecter|service temporairement indisponible|habilite javascript para continuar.|active javascript para ver esta página
la página solicitada no existe|su sesión ha expirado|servicio no disponible|请启用 javascript|页面不存在|您的会话已过期|javascript を有効にしてください
<html><head><title>0 not found</title></head><body><center><h0>0 not found</h0></center></body></html>|<html><head><title>gateway timeout</title></head>|=vlookup(b0,sheet0!a:c,0,false)
=sum(a0:a0)|$x,xxx|upstream timed out (0: connection timed out) while reading response header from upstream|ora-0: value too large for column (actual: 0, maximum: 0)|keyerror: 'name'
file "/usr/lib/python0/site-packages/app.py", line 0, in run|warning: undefined array key in /var/www/html/view.php on line 0
exception in thread "main" java.lang.nullpointerexception at com.app.main.run(main.java:0)|verify you are human by completing the action below.
needs to review the security of your connection before proceeding.|our systems have detected unusual traffic from your computer network.|please solve this captcha to continue
solve the captcha to proceed.|this process is automatic. your browser will redirect to your requested content shortly. please allow up to 0 seconds.|performance & security by cloudflare
ray id: 0|accept all - reject all - more options|accept¦reject¦manage cookies|forgot password?|forgot your username or password?|not a member? subscribe now.
access to this content requires a subscription.|please wait 0 seconds before trying again.|you must wait 0 minutes before searching again.|retry|please retry.|tap to retry
the administrator has been notified.|the webmaster has been informed.|we apologize for the inconvenience.|sorry for the trouble.|sorry, something went wrong on our end.
check the web address or go back to the home page.|it may have been moved, renamed or deleted.|the page may have been removed, had its name changed, or is temporarily unavailable.
acceso denegado|no tiene permiso para acceder a esta página.|inténtelo de nuevo más tarde.|actívelo para continuar|ihre sitzung ist abgelaufen, bitte melden sie sich neu an
zugriff verweigert, bitte anmelden|请启用脚本|请在浏览器中启用脚本|请启用 javascript 以查看网页|=vlookup(b0,table,0,false)|=if(isna(a0),"",a0)|=concat(a0," ",b0)|home > search > results|home¦about us¦terms of service¦contact us
""".strip()

# Unfilled placeholders and form instructions, beside those of placeholders().
FORMS = """
your abstract goes here|your title here|[paste abstract here]|paste abstract here|click here to enter text|type here|enter abstract here|[insert abstract]|[tbd]|[n]|[institution name]
[citation needed]|[year]|[xx]|<year>|todo: add figures|(todo)|todo|note to self|{insert text}|xx%|replace this text|do not exceed 0 words.|project summary (max. 0 words)|0 characters left
(up to 0 words)|for office use only|titel hier eingeben|insérer le titre ici|escriba aquí el título|click here to enter text.|click or tap to enter a date.|choose an item.|tap here to type
replace this paragraph with your own text|delete these instructions before submitting|delete this line before submission|(remove this text before submitting)
instructions: summarize the project in no more than 0 words.|summarize the proposed work in language for a general audience.|provide a brief summary of the project in lay language.
provide a plain language abstract here|state the objectives and methods of the project.|describe the goals, methods and expected outcomes here.|abstract (max 0 characters)
project abstract (0 words maximum):|0 characters remaining|for internal use only - do not write below this line.|office use only|applicant to provide summary|[insert name of institution]
[insert name of applicant]|<insert partner name>|<partner name>|<name of organisation>|<name of applicant>|(citation)|{insert text here}|{insert summary here}
{insert paragraph on impact here}|zusammenfassung hier eingeben.|bitte zusammenfassung einfügen|text hier einfügen|résumé (0 mots maximum) :|résumé du projet à insérer ici
texte à insérer par le demandeur|à compléter|resumen del proyecto (máximo 0 caracteres).|escriba aquí el resumen|introduzca el texto aquí|inserire qui il testo|inserir resumo aqui
state the application's broad, long-term objectives and specific aims.|describe concisely the research design and methods for achieving the stated goals.|describe the expected results.
describe the specific aims.|describe the approach.|do not include figures or tables.|do not include proprietary or confidential information.|the abstract should not exceed 0 lines of text.
enter a short description of at most 0 characters.|enter a project description (maximum 0 characters).|provide a summary suitable for the public.
summarize the need for the project, the activities and the expected outcomes.|use blank lines to separate paragraphs.|leave this field blank.|leave blank
example: this project aims to [verb] [noun].|field 0 - description - 0 characters remaining|max. 0 characters|ask pi for details|todo: ask pi|pi to supply|pi to confirm
note to self: check this|[note: expand this section later]|expand this section|insert sentence here|{insert sentence here}|template v0|copy of form v0|[number] participants|[insert number]
[insert value]|<name of institution>|<name of person>|[citation]|[ref]|$xxx|$xx,xxx
""".strip()

# Shapes of template marks, with a for a run of letters.
MARKS = """
=a(a0)|=a(a0,a0)|=a(a0:a0)|=a(a0,a,0,0)|=a(a0,a!a:a,0,a)|{{a}}|{{ a }}|{{a_a}}|{{ a_a }}|${a}|${a_a}|${a.a}|#{a}|#{a_a}|%a%|%%a%%|%%a_a%%|%a_a%|<<a>>|<<a_a>>|<<a a>>|@@a@@|@@a_a@@|@a@|@a_a@|__a__|__a_a__|{% a %}|{% a a %}|{% a %}{% a %}|<%= a %>|<%= a_a %>|<% a %>
$a,a|____ a|__________ a
""".strip()


def examples(block: str) -> list[str]:
    """The examples of a block, one string each; a broken bar stands for a bar within one."""
    return [e.replace("¦", " | ") for line in block.splitlines() for e in line.split("|") if e.strip()]


def placeholders() -> list[str]:
    """Bracketed and bare combinations of what to do and what is missing."""
    marks = (("[", "]"), ("<", ">"), ("(", ")"), ("", ""))
    told = [f"{a}{verb} {what}{b}" for verb in ("insert", "enter", "add", "type") for what in ("title here", "project title", "name", "text here", "summary") for a, b in marks]
    bare = [f"{a}{what}{b}" for what in ("title", "name", "project", "project title", "date", "number", "place", "reference", "institution", "organisation name") for a, b in (*marks[:2], ("{", "}"))]
    return told + bare
