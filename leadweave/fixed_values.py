"""Fixed values of the domain.

Everything in this module is a FIXED VALUE: word lists, lookup tables, limits, labels and
message texts that the results must carry exactly. They are data, written plainly and in
their natural order; no logic lives here.
"""

# ---------------------------------------------------------------- states and ranks
CONTACT_VERIFIED = "VERIFICADO"
CONTACT_UNCONFIRMED = "NO CONFIRMADO"
CONTACT_NOT_FOUND = "NO ENCONTRADO"
CHECK_EXISTS = "EXISTE"
CHECK_MISSING = "NO_EXISTE"
SITE_OK = "OK"
SITE_DOWN = "CAIDO"
SITE_NONE = "SIN_WEB"
SITE_ONLY_SOCIAL = "SOLO_REDES"
SITE_BLOCKED = "BLOQUEADO"
RUN_OPEN = "EN_CURSO"
RUN_DONE = "TERMINADA"
RUN_FAILED = "FALLIDA"
RUN_STOPPED = "DETENIDA"
RUN_BLOCKED = "BLOQUEADO"
KIND_OWN = "web_propia"
KIND_SOCIAL = "red_social"
KIND_CONTACT = "whatsapp"
KIND_AGGREGATOR = "agregador"
KIND_MAPS = "google"
KIND_INVALID = "invalido"
PRINT_NUMBER = "numero"
PRINT_WEB = "web"
PRINT_SOCIAL = "red"
PRINT_RANK = {"numero": 0, "web": 1, "red": 2}
SOURCE_RANK = {"manual": -1, "maps": 0, "web": 1, "linktree": 2, "otra": 3}
PLACEMENT_RANK = {"flotante": 0, "header": 0, "cuerpo": 1, "footer": 2}
SEVERITY_RANK = {"alta": 0, "media": 1, "baja": 2}
CONTACT_STATE_RANK = {"confirmado": 0, "verificado": 1, "por_probar": 3, "sin_whatsapp": 4}
OPPORTUNITY_RANK = {"ALTA": 0, "MEDIA": 1, "BAJA": 3}
OPPORTUNITY_RANK_NONE = 2

# ---------------------------------------------------------------- hosts
CONTACT_HOSTS = ["wa.me", "api.whatsapp.com", "web.whatsapp.com", "wa.link", "walink.co", "chat.whatsapp.com"]
AGGREGATOR_HOSTS = [
    "linktr.ee", "beacons.ai", "linkin.bio", "taplink.cc", "bio.link", "lnk.bio",
    "campsite.bio", "solo.to", "linkr.bio", "msha.ke", "allmylinks.com", "linkbio.co",
]
MAPS_HOSTS = ["maps.app.goo.gl", "g.page", "maps.google.com", "g.co"]
SEARCH_HOST_PATTERN = r"(?:^|\.)google\.[a-z]{2,3}(?:\.[a-z]{2})?$"
TRACKING_PARAM_PATTERN = r"(?i)^(?:utm_.*|fbclid|gclid|gbraid|wbraid|mc_cid|mc_eid|igshid)$"
MAPS_KEPT_PARAMS = ["cid", "q", "query", "query_place_id", "ftid"]
SHARED_PLATFORM_SEGMENTS = {
    "linktr.ee": 1, "beacons.ai": 1, "linkin.bio": 1, "taplink.cc": 1, "bio.link": 1, "lnk.bio": 1,
    "campsite.bio": 1, "solo.to": 1, "linkr.bio": 1, "msha.ke": 1, "allmylinks.com": 1, "linkbio.co": 1,
    "sites.google.com": 2, "google.com": 2, "bit.ly": 1, "tinyurl.com": 1, "cutt.ly": 1,
    "booksy.com": 3, "fresha.com": 3, "agendapro.com": 3, "reservo.cl": 2,
    "doctoralia.cl": 3, "doctoralia.com": 3, "doctoralia.com.ar": 3, "doctoralia.com.mx": 3,
    "mercadolibre.cl": 3, "mercadolibre.com.ar": 3, "mercadolibre.com.mx": 3,
    "pedidosya.cl": 3, "pedidosya.com.ar": 3, "rappi.cl": 3, "ubereats.com": 4,
    "tripadvisor.cl": 2, "tripadvisor.com": 2, "booking.com": 3, "airbnb.cl": 2, "airbnb.com": 2,
    "yelp.com": 2, "paginasamarillas.cl": 3, "amarillas.cl": 3,
}
SHARED_SUFFIX_SEGMENTS = {"wixsite.com": 1}
SOCIAL_NETWORKS = {
    "instagram.com": "instagram", "facebook.com": "facebook", "fb.com": "facebook", "fb.me": "facebook",
    "tiktok.com": "tiktok", "youtube.com": "youtube", "linkedin.com": "linkedin", "x.com": "x",
    "twitter.com": "x", "pinterest.com": "pinterest", "pinterest.cl": "pinterest",
}
SOCIAL_CANONICAL_HOST = {
    "instagram": "www.instagram.com", "facebook": "www.facebook.com", "tiktok": "www.tiktok.com",
    "youtube": "www.youtube.com", "linkedin": "www.linkedin.com", "x": "x.com", "pinterest": "www.pinterest.com",
}
SOCIAL_NOT_PROFILE = {
    "instagram": ["p", "reel", "reels", "tv", "explore", "accounts", "stories", "direct", "about", "legal"],
    "facebook": [
        "sharer", "sharer.php", "share", "share.php", "plugins", "tr", "dialog", "login", "login.php",
        "policies", "help", "l.php", "hashtag", "groups", "watch", "events", "photo.php", "photo", "story.php",
    ],
    "tiktok": ["share", "embed", "tag", "music", "discover", "search"],
    "youtube": ["watch", "embed", "shorts", "playlist", "results", "feed", "redirect"],
    "linkedin": ["shareArticle", "sharing", "feed", "login", "jobs"],
    "x": ["intent", "share", "home", "search", "hashtag", "i", "login"],
    "pinterest": ["pin", "search", "ideas"],
}
SOCIAL_TWO_SEGMENTS = ["channel", "c", "user", "company", "in", "school", "showcase", "pages"]
LOGIN_HOSTS = {
    "accounts.google.com": "Google", "login.microsoftonline.com": "Microsoft",
    "login.live.com": "Microsoft", "users.wix.com": "Wix",
}
BUILDER_HOSTS = {
    "wixsite.com": "Wix", "manus.space": "Manus", "lovable.app": "Lovable", "webflow.io": "Webflow",
    "squarespace.com": "Squarespace", "business.site": "Google Business Site",
    "negocio.site": "Google Business Site", "sites.google.com": "Google Sites", "blogspot.com": "Blogger",
    "wordpress.com": "WordPress.com", "godaddysites.com": "GoDaddy Website Builder", "jimdosite.com": "Jimdo",
    "mitiendanube.com": "Tiendanube", "myshopify.com": "Shopify", "vercel.app": "Vercel", "netlify.app": "Netlify",
}
BUILDER_PATTERNS = {
    "WordPress": r"wp-content/|wp-includes/",
    "Elementor": r"elementor",
    "Divi": r"et_pb_|/themes/divi",
    "Wix": r"static\.wixstatic\.com|wix\.com website builder|parastorage\.com",
    "Shopify": r"cdn\.shopify\.com|shopify\.theme",
    "PrestaShop": r"prestashop",
    "Squarespace": r"static1\.squarespace\.com",
    "Webflow": r"data-wf-page|webflow\.(?:com|io)",
    "Jimdo": r"jimdo",
    "GoDaddy Website Builder": r"img1\.wsimg\.com",
    "Google Sites": r"sites\.google\.com/|gstatic\.com/atari",
    "Tokko Broker": r"tokkobroker",
    "BuscadorProp": r"buscadorprop",
    "Houzez": r"houzez",
    "Lovable": r"lovable\.(?:app|dev)|gpteng\.co|content=\"lovable",
    "Joomla": r"/media/jui/|/media/system/js/|joomla!",
    "Blogger": r"blogger\.com/static|\.blogspot\.com",
}
THEME_PATTERN = r"wp-content/themes/([a-z0-9_-]+)/"
TEMPLATE_BUILDERS = [
    "Wix", "Manus", "Lovable", "GoDaddy Website Builder", "Google Sites", "Google Business Site",
    "Jimdo", "Blogger", "WordPress.com", "Squarespace", "Tiendanube",
]

# ---------------------------------------------------------------- page text patterns
SKIP_TAGS = ["script", "style", "noscript", "template", "svg", "head", "iframe", "object", "canvas"]
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "br", "button", "dd", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "label", "li", "main", "nav", "ol", "option", "p", "pre", "section",
    "table", "td", "th", "tr", "ul",
]
EMAIL_PATTERN = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PLACE_CUE_PATTERN = r"(?iuU)\b(?:comunas?|sector(?:es)?|cobertura|atendemos)\b"
TRUST_PATTERNS = {
    "testimonios": r"(?iuU)\btestimonios?\b|\blo que dicen\b|\bnuestros clientes opinan\b|\bopiniones de (?:nuestros )?clientes\b",
    "reseñas": r"(?iuU)\brese[ñn]as?\b|\breviews?\b|\bcalificaci[oó]n(?:es)?\b|★",
    "experiencia": r"(?iuU)\b\d{1,3}\+?\s*años de (?:experiencia|trayectoria)\b|\bm[aá]s de \d{1,3} años\b|\bdesde (?:el (?:año )?)?(?:19|20)\d{2}\b",
    "certificaciones": r"(?U)\bSEC\b|\b[Cc]ertificad[oa]s?\b|\b[Cc]ertificaci[oó]n(?:es)?\b|\bISO \d{3,5}\b|\b[Aa]utorizad[oa]s? (?:por (?:la )?)?SEC\b",
    "garantía": r"(?iuU)\bgarant[ií]as?\b|\bgarantizad[oa]s?\b",
}
MAX_SNIPPETS = 3
SNIPPET_WIDTH = 160
COPYRIGHT_PATTERN = (
    r"(?iu)(?:©|\(c\)|&copy;|copyright)\s*(?:(?:19|20)\d{2}\s*[-–—]\s*)?((?:19|20)\d{2})"
    r"|((?:19|20)\d{2})[^\n]{0,40}derechos reservados"
    r"|derechos reservados[^\n]{0,40}?((?:19|20)\d{2})"
)
LOCAL_BUSINESS_TYPES = [
    "LocalBusiness", "HomeAndConstructionBusiness", "Locksmith", "Plumber", "Electrician", "HVACBusiness",
    "RoofingContractor", "GeneralContractor", "HousePainter", "MovingCompany", "ProfessionalService",
    "AutomotiveBusiness", "AutoRepair", "Store", "HealthAndBeautyBusiness", "MedicalBusiness", "Dentist",
    "LegalService", "RealEstateAgent", "FoodEstablishment", "Restaurant", "LodgingBusiness",
    "EmergencyService", "FinancialService", "ChildCare", "DryCleaningOrLaundry", "TravelAgency", "SelfStorage",
]
MAX_H2 = 30
MAX_MENU = 40
MAX_INTERNAL_LINKS = 300
MAX_LINKS_CHECKED = 20
MAX_IMAGES_CHECKED = 15
MAX_INNER_PAGES = 3
MAP_EMBED_PATTERN = r"google\.[a-z.]+/maps|maps\.google\."
TECHNICAL_LINK_PATTERN = r"(?i)/(?:wp-admin|wp-login\.php|wp-json|xmlrpc\.php|cdn-cgi|imunify[\w-]*|feed|comments/feed)(?:/|$|\?)"

# ---------------------------------------------------------------- contact links on pages
LINK_START = r"(?<![\w.-])(?:(?:https?:)?//)?"
PHONE_PARAM = r"[^\s\"'<>]*?(?<=[?&])phone=([^&\s\"'<>#]*)"
NUMBER_LINK_PATTERNS = [
    r"(?i)" + LINK_START + r"(?:www\.)?wa\.me/(?!message/)(?:c/)?(\+?[\d%().-]+)",
    r"(?i)" + LINK_START + r"(?:api|web)\.whatsapp\.com/send/?\?" + PHONE_PARAM,
    r"(?i)(?<![\w.-])whatsapp://send/?\?" + PHONE_PARAM,
]
MESSAGE_LINK_PATTERN = r"(?i)" + LINK_START + r"(?:www\.)?wa\.me/message/[A-Za-z0-9]+"
SHORT_LINK_PATTERN = r"(?i)" + LINK_START + r"(?:www\.)?(?:wa\.link|walink\.co)/[A-Za-z0-9_-]+"
GROUP_LINK_PATTERN = r"(?i)" + LINK_START + r"chat\.whatsapp\.com/[A-Za-z0-9_-]+"
LINK_TAIL = r"[^\s\"'<>`\\]*"
PLUGIN_NUMBER_PATTERN = (
    r"(?i)[\"']?\b(?:telephone|phone|phone_?number|number|numero|whatsapp|whatsapp_?number|wa_?number)\b[\"']?"
    r"\s*[:=]\s*[\"'](\+?\d[\d\s().-]{5,22}\d)[\"']"
)
PLUGIN_ATTRIBUTE_PATTERN = r"(?i)^data-(?:number|phone|telephone|whatsapp|wa-?number|whatsapp-number)$"
CONTACT_CUE_PATTERN = r"(?i)whatsapp|joinchat|\bwa[-_]|ht[-_]ctc|click.?to.?chat|getbutton|\bwpp"
FLOATING_SCRIPT_PATTERN = r"(?i)joinchat|ht[-_]ctc|getbutton|float|flotante|whatsapp[-_]?widget|wa[-_]widget"
FLOATING_TOKEN_PATTERN = r"(?i)float|flotante|fixed|sticky|joinchat|ht-ctc|wh-widget|getbutton"
FIXED_STYLE_PATTERN = r"(?i)position\s*:\s*fixed"
HEADER_TOKENS = ["header", "site-header", "main-header", "navbar", "topbar", "top-bar", "masthead", "elementor-location-header"]
FOOTER_TOKENS = ["footer", "site-footer", "main-footer", "pie", "pie-de-pagina", "elementor-location-footer"]
# Eleven to fifteen digits that begin with a country code other than those of the number plan.
FOREIGN_NUMBER_PATTERN = r"^(?!56|54|52|1|34|0)[2-9]\d{9,14}$"
CUE_WINDOW = 300
META_REFRESH_PATTERN = r"(?i)<meta[^>]+http-equiv=[\"']?refresh[^>]*url=([^\"'>\s]+)"
MAX_HOPS = 5
INVALID_NUMBER_REASON = "Número de WhatsApp no válido"
GROUP_INVITE_REASON = "Invitación a un grupo de WhatsApp, no el contacto del negocio"
DEAD_SHORT_LINK_REASON = "El acortador no lleva a un WhatsApp válido"
SOURCE_WORDS = {
    "manual": "tu confirmación", "maps": "Google Maps", "web": "su web", "linktree": "su Linktree", "otra": "otra fuente",
}
REASON_MANUAL = "Confirmado por ti: abriste el chat y el WhatsApp existe."
REASON_NO_NUMBER = "Enlace de WhatsApp sin número visible (wa.me/message)."

# ---------------------------------------------------------------- site status
DEAD_SITE_PATTERNS = {
    "El dominio está a la venta":
        r"este dominio (?:esta|se encuentra) (?:a la venta|en venta)|domain (?:is )?for sale|buy this domain|compra(?:r)? este dominio",
    "La cuenta de hosting está suspendida":
        r"account (?:has been )?suspended|cuenta (?:ha sido )?suspendida|sitio (?:web )?suspendido|website suspended",
    "El dominio está estacionado (sin web)":
        r"parked (?:domain|free)|dominio estacionado|domain parking|sedoparking|parkingcrew|bodis\.com",
    "La web muestra un error de base de datos (WordPress caído)":
        r"error establishing a database connection|error al establecer una conexion con la base de datos",
    "El servidor muestra una carpeta vacía (Index of /)": r"(?m)^index of /",
}
PLACEHOLDER_PATTERNS = {
    "La web está en construcción o en mantenimiento":
        r"en construccion|under construction|coming soon|proximamente|en mantenimiento|maintenance mode|estamos trabajando en (?:nuestro|el) sitio",
    "La web muestra la página por defecto del hosting":
        r"default web site page|apache2 \w+ default page|welcome to nginx|it works!|congratulations! your (?:website|domain)|felicidades.{0,40}(?:tu sitio|tu dominio)",
}
PLACEHOLDER_MAX_TEXT = 400
BOT_WALL_PATTERN = (
    r"(?iu)just a moment|attention required|checking your browser|verifica(?:ndo)? que eres (?:un )?humano"
    r"|ddos protection|enable javascript and cookies to continue"
)
BOT_WALL_TEXT = 2000
RENDER_MIN_TEXT = 200
HTTP_REASONS = {
    400: "petición rechazada", 401: "pide usuario y contraseña", 403: "acceso prohibido",
    404: "página no encontrada", 410: "la página fue eliminada",
    429: "demasiadas visitas, el servidor rechazó la revisión", 500: "error interno del servidor",
    502: "el servidor no responde", 503: "servidor caído o en mantenimiento", 504: "el servidor tardó demasiado",
}
HTTP_REASON_OTHER = "error del servidor"
TRANSIENT_STATUS = [429, 500, 502, 503, 504, 520, 521, 522, 523, 524]
TLS_REASON = "El certificado de seguridad (SSL) es inválido o está vencido: el navegador les muestra una advertencia a los visitantes"
BOT_WALL_REASON = "La web tiene una protección anti-bots y no dejó revisarla"
DNS_REASON = "El dominio no existe o no tiene la web configurada (sin DNS)"
REFUSED_REASON = "El servidor rechaza la conexión"
NO_CONNECTION_REASON = "No se pudo conectar con el servidor de la web"
LOAD_TIMEOUT_REASON = "La web no terminó de cargar a tiempo"
BROWSER_REASON = "El navegador no pudo abrir la web"
DNS_HINTS = ["getaddrinfo", "name or service not known", "nodename", "11001", "no address"]
REFUSED_HINTS = ["refused", "10061", "deneg", "rechaz"]
REASON_SOCIAL_LINK = "El enlace es una red social, no una web propia"
REASON_CONTACT_LINK = "El enlace es un WhatsApp, no una web"
REASON_BAD_ADDRESS = "La dirección de la web no es válida"
REASON_REDIRECT_SOCIAL = "La web redirige a una red social"
REASON_LINK_PAGE_DOWN = "La página de enlaces (Linktree) no abre"
REASON_LINK_PAGE_ONLY = "Usa una página de enlaces (Linktree o similar) en vez de una web propia"
NO_ANSWER_HINT = "no respondió"
PAGE_PRIORITY_PATTERNS = [
    r"contact|cotiza|presupuesto|ubicacion|donde-estamos|agenda|reserva",
    r"servicio|service|trabajos|productos|precios",
    r"nosotros|quienes|empresa|about|historia|equipo",
]
NOT_A_PAGE_PATTERN = r"(?i)\.(?:pdf|jpe?g|png|gif|webp|svg|zip|rar|docx?|xlsx?|pptx?|mp4|mp3)$"
HTML_CONTENT_TYPES = ["", "text/html", "application/xhtml+xml"]
META_CHARSET_PATTERN = r"<meta[^>]+charset=[\"']?([\w-]+)"
FRIENDLY_ERRORS = [
    (["has been closed", "Target closed", "browser not connected"],
     "Se cerró la ventana del navegador durante la búsqueda. Lo encontrado hasta ese momento quedó guardado. "
     "No cierres la ventana de Chromium mientras busca."),
    (["ERR_INTERNET_DISCONNECTED", "ERR_NETWORK_CHANGED", "ERR_NAME_NOT_RESOLVED", "getaddrinfo failed"],
     "Parece que no hay conexión a internet. Revisa tu conexión y vuelve a intentarlo."),
    (["Executable doesn't exist", "playwright install"],
     "Falta instalar el navegador del programa. Ejecuta: uv run playwright install chromium"),
    (["CDP", "No se pudo conectar", "Timed out waiting for CDP"],
     "El navegador no pudo abrirse. Cierra las ventanas de Chromium que hayan quedado abiertas y vuelve a intentarlo."),
]

# ---------------------------------------------------------------- listings
RATING_LABEL_PATTERN = r"(?iu)^\s*(\d+(?:[.,]\d+)?)\s+estrellas?\s*$"
REVIEWS_LABEL_PATTERN = r"(?iu)^\s*(\d[\d.\s]*)\s+reseñas?\s*$"
LABEL_PREFIX_PATTERN = r"(?iu)^\s*(?:Dirección|Teléfono|Sitio web|Address|Phone|Website)\s*:\s*"
WEEKDAYS = ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"]
HOURS_LABEL_PATTERN = (
    r"(?iu)^\s*(lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bado|domingo)\s*,\s*(.+?)(?:\s*,\s*Copiar el horario)?\s*$"
)
HELP_HOST_PATTERN = r"(?i)^https?://(?:support|policies|accounts)\.google\."
NOT_ABOUT_PATTERN = r"(?iu)^(?:fotos|resumen de reseñas|reseñas|otras personas|resultados web|saca el máximo|horas punta)"
DESCRIPTION_HEADING_PATTERN = r"(?iu)^(?:del propietario|descripción|acerca de)"
SERVICE_HEADING_PATTERN = r"(?iu)servicio"
OWN_REGION_PATTERN = r"^(?:Información de|Acciones para|Information for|Actions for)\b"
END_OF_LIST_PATTERN = r"(?i)final de la lista|end of the list"
BLOCK_URL_PATTERN = r"google\.[a-z.]+/sorry/|/sorry/index"
BLOCK_TEXT_PATTERN = r"(?iu)tr[aá]fico inusual|unusual traffic|no soy un robot|i'?m not a robot|recaptcha|captcha"
CARD_SITE_LABELS = ["Visitar el sitio web", "Visit"]
CARD_SITE_VALUE = "Sitio web"
CARD_PHONE_PATTERN = r"^\+?[\d\s().-]{7,}$"
POSTAL_CODE_PATTERN = r"^(?:[A-Z]?\d{4,7}[A-Z]{0,3})\s+"
NOT_LOCALITY_PATTERN = (
    r"(?iuU)\bregi[oó]n\b|metropolitana|o'?higgins|valpara[ií]so|b[ií]o\s?b[ií]o|\bmaule\b|araucan[ií]a|los lagos|los r[ií]os|"
    r"coquimbo|antofagasta|atacama|tarapac[aá]|arica|ñuble|ays[eé]n|magallanes|^provincia de|"
    r"^(?:chile|argentina|per[uú]|colombia|m[eé]xico|espa[ñn]a|spain|uruguay|paraguay|bolivia|ecuador|venezuela|"
    r"brasil|brazil|panam[aá]|costa rica|guatemala|honduras|el salvador|nicaragua|cuba|puerto rico|"
    r"rep[uú]blica dominicana|canad[aá]|canada|reino unido|united kingdom|uk|francia|france|italia|italy|"
    r"alemania|germany|portugal|estados unidos|united states|usa|ee\.?\s?uu\.?|eeuu)$"
)

# ---------------------------------------------------------------- contact-list import
PHONE_CELL_PATTERN = r"^\+?[\d\s().-]{7,}$"
PHONE_IN_TEXT_PATTERN = r"\+?\d[\d\s().-]{6,}\d"
TIME_CELL_PATTERN = r"(?i)^\d{1,2}[.:]\d{2}\s*(?:[ap]\.?\s?m\.?)?$"
NOTE_CELLS = ["checked", "check", "ok", "✓", "✔", "listo"]
NO_NAME = "(sin nombre)"

# ---------------------------------------------------------------- rubric and scoring
RUBRIC_VERSION = "2026-10-04.1"
RUBRIC_PARAMS = [
    (1, "Primera impresión / Hero", "ia"),
    (2, "Identidad visual propia (vs. plantilla genérica)", "ia"),
    (3, "Evidencia / portafolio de trabajo real", "ia"),
    (4, "Navegación y claridad de menú", "ia"),
    (5, "Velocidad de carga", "codigo"),
    (6, "Responsive / mobile", "ia"),
    (7, "Llamado a la acción (CTA)", "ia"),
    (8, "Prueba social / confianza", "ia"),
    (9, "Coherencia y funcionalidad de enlaces", "codigo"),
    (10, "Actualización / vigencia del contenido", "ia"),
]
SPEED_BANDS = [(1.5, 10), (2.5, 8), (4.0, 6), (6.0, 4), (9.0, 2)]
SPEED_REST = 1
LINK_BANDS = [(0, 10), (1, 8), (3, 6), (6, 4)]
LINK_REST = 2
HIGH_SCORE_BELOW = 50
LOW_SCORE_FROM = 70
GOOD_RATING = 4.3
GOOD_REVIEWS = 20
MISSING_PARAMS_ERROR = "La IA no puntuó todos los parámetros con evidencia: no hay score total."
JUDGMENT_CAPS = {"problemas": 5, "oportunidades": 6, "puntos_fuertes": 3}
JUDGMENT_WORDS = {"problemas": "Problema", "oportunidades": "Oportunidad", "puntos_fuertes": "Punto fuerte"}
REFUSED_ERROR = "El modelo se negó a analizar esta web."
CUT_ERROR = "La respuesta de la IA se cortó antes de terminar."
FORMAT_ERROR = "La IA respondió con un formato inválido."
MAX_VISIBLE_TEXT = 6000
HOURS_WORD_PATTERN = r"(?iuU)\b(?:lunes|horario|24 horas|24/7|abierto|atencion de)\b"
SERVICES_WORD_PATTERN = r"(?iuU)\bservicios?\b"

# ---------------------------------------------------------------- labels and export
CSV_COLUMNS = [
    ("Negocio", "name"), ("Rubro", "category"), ("Ciudad", "city"), ("WhatsApp", "whatsapp_url"),
    ("Número", "whatsapp_number"), ("Estado WhatsApp", "whatsapp_state"), ("Confianza", "confidence"),
    ("Por qué", "confidence_reason"), ("Botón de WhatsApp roto", "broken_button"), ("Teléfono", "phone"),
    ("Web", "website"), ("Estado web", "website_status"), ("Motivo web", "website_reason"),
    ("Problemas detectados", "findings"), ("Puntaje web (IA)", "score"), ("Oportunidad", "opportunity"),
    ("Rating", "rating"), ("Reseñas", "reviews"), ("Dirección", "address"), ("Instagram", "instagram"),
    ("Facebook", "facebook"), ("Google Maps", "maps_url"), ("Búsqueda", "query"),
]
STATE_LABELS = {
    "confirmado": "Confirmado por ti", "verificado": "Verificado (publicado por el negocio)",
    "por_probar": "Por probar (celular)", "sin_whatsapp": "Sin WhatsApp",
}
TO_VERIFY = "POR VERIFICAR"
DISCARD_REASON = "El WhatsApp no existe (lo comprobaste al abrir el chat)"
SORT_LABELS = {
    "whatsapp": "WhatsApp (confirmados primero)", "oportunidad": "Más problemas en su web primero",
    "resenas": "Más reseñas", "rating": "Mejor rating", "nombre": "Nombre",
}
FILTER_LABELS = {
    "whatsapp": ("Con WhatsApp", "WhatsApp verificado o confirmado por ti"),
    "probar": ("Celular por probar", "No publica WhatsApp, pero tiene un celular"),
    "web_mala": ("Web mala", "Con IA, puntaje menor a 50; sin IA, al menos un problema grave detectado"),
    "rating": ("Rating > 4,5", "Más de 4,5 estrellas en Google"),
    "resenas": ("Más de 100 reseñas", "Más de 100 reseñas en Google"),
    "whatsapp_web_mala": ("WhatsApp + web mala", "Tiene WhatsApp y su web está mala: el mejor lead para ofrecer un rediseño"),
    "oportunidad": ("Grandes oportunidades", "Oportunidad ALTA: web mala (puntaje < 50 con IA), con buen rating y reseñas"),
}
SEO_LABELS = {
    "titulo_con_ciudad": "Título con servicio y ciudad", "h1_unico": "Un solo título principal (H1)",
    "meta_descripcion": "Descripción para Google", "cobertura": "Comunas o zona de cobertura",
    "nombre_direccion_telefono": "Nombre, dirección y teléfono visibles",
    "datos_estructurados": "Datos estructurados de negocio local", "mapa": "Mapa o enlace a su ficha de Google",
}
CHECKLIST_LABELS = {
    "servicios": "Servicios", "cobertura": "Comunas / cobertura", "telefono": "Teléfono", "whatsapp": "WhatsApp",
    "horarios": "Horarios", "diferenciadores": "Diferenciadores", "testimonios": "Testimonios",
    "resenas": "Reseñas", "confianza": "Elementos de confianza",
}
FIELD_LABELS = {
    "business_name": "Nombre", "category": "Rubro", "phone_raw": "Teléfono",
    "phone_e164": "Teléfono (formato internacional)", "whatsapp_url": "WhatsApp",
    "whatsapp_confidence": "Confianza del WhatsApp", "whatsapp_broken_web": "Botones de WhatsApp rotos en su web",
    "website": "Web", "website_maps": "Lo que Maps mostraba como «Sitio web»", "website_status": "Estado de la web",
    "instagram": "Instagram", "facebook": "Facebook", "address": "Dirección", "city": "Ciudad", "commune": "Comuna",
    "opening_hours": "Horario", "rating": "Rating", "review_count": "Reseñas", "services": "Servicios",
    "description": "Descripción",
}
SOURCE_NAMES = {
    "maps": "Google Maps", "web": "su web", "linktree": "su Linktree", "manual": "confirmado por ti",
    "otra": "otra fuente enlazada por el negocio",
}
PLACEMENT_NAMES = {"flotante": "botón flotante", "header": "menú o encabezado", "cuerpo": "contenido", "footer": "pie de página"}
DAY_NAMES = ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"]
MONTH_NAMES = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto",
    "septiembre", "octubre", "noviembre", "diciembre",
]
LOG_KEEP_DAYS = 30
LOG_MAX_LINES = 400
DAY_LIST_LIMIT = 30
SEARCH_LIST_LIMIT = 500
MAX_LISTINGS = 120
FRESH_DAYS = 30

# FIXED VALUES: identifiers of place pages, the view part of their paths, and what contact links carry.
PLACE_ID_PATTERN = r"(?:place_id[:=]|query_place_id=|!19s)(ChI[A-Za-z0-9_-]{10,})"
FEATURE_ID_PATTERN = r"(?i)!1s(0x[0-9a-f]+:0x[0-9a-f]+)"
CID_PATTERN = r"[?&]cid=(\d+)"
MAP_VIEW_PATTERN = r"/@-?\d+(?:\.\d+)?,-?\d+(?:\.\d+)?(?:,[\d.]+[a-z]?)*"
LINK_DIGITS_PATTERN = r"(?:wa\.me/|phone=)\+?(\d{8,})"
SHOWN_DIGITS_PATTERN = r"wa\.me/(\d+)"
SHORT_LINK_PRINT_PATTERN = r"(?i)((?:wa\.link|walink\.co)/[^/?#\s]+|wa\.me/message/[^/?#\s]+)"

# FIXED VALUES: three-digit area codes of Argentina (11 has two digits, all others four) and of Canada.
AR_AREAS = (
    "220|221|223|230|236|237|249|260|261|263|264|266|280|291|294|297|298|299|336|341|342|343|345|348|"
    "351|353|358|362|364|370|376|379|380|381|383|385|387|388"
)
CA_AREAS = (
    "204|226|236|249|250|257|263|289|306|343|354|365|367|368|382|403|416|418|428|431|437|438|450|468|474|506|514|519|548|"
    "579|581|584|587|604|613|639|647|672|683|705|709|742|753|778|780|782|807|819|825|867|873|879|902|905|942"
)
# FIXED VALUES: the numbering plan. Region, calling code, trunk prefix, valid national numbers, possible
# mobiles, and the international grouping of full numbers (first matching rule wins).
NUMBERING_PLAN = [
    ("CL", "56", "", r"(?:2[1-3]|3[2-5]|[47][1-35]|5[1-3578]|6[13-57]|8[1-9]|9[2-9])\d{7}|600\d{7,8}|800\d{6}", r"9[2-9]\d{7}", (
        (r"^56(9)(\d{4})(\d{4})$", "+56 $1 $2 $3"), (r"^56(2)([1-3]\d{3})(\d{4})$", "+56 $1 $2 $3"), (r"^56([3-8]\d)(\d{3})(\d{4})$", "+56 $1 $2 $3"))),
    ("AR", "54", "0", r"9?(?:11\d{8}|[23]\d{9})", r"9(?:11\d{8}|[23]\d{9})", (
        (r"^549(11)(\d{4})(\d{4})$", "+54 9 $1 $2-$3"), (rf"^549({AR_AREAS})(\d{{3}})(\d{{4}})$", "+54 9 $1 $2-$3"),
        (r"^549([23]\d{3})(\d{2})(\d{4})$", "+54 9 $1 $2-$3"), (r"^54(11)(\d{4})(\d{4})$", "+54 $1 $2-$3"),
        (rf"^54({AR_AREAS})(\d{{3}})(\d{{4}})$", "+54 $1 $2-$3"), (r"^54([23]\d{3})(\d{2})(\d{4})$", "+54 $1 $2-$3"))),
    ("MX", "52", "", r"[2-9]\d{9}", r"[2-9]\d{9}", (
        (r"^52(33|5[56]|81)(\d{4})(\d{4})$", "+52 $1 $2 $3"), (r"^52([2-9]\d{2})(\d{3})(\d{4})$", "+52 $1 $2 $3"))),
    ("CA", "1", "", rf"(?:{CA_AREAS})[2-9]\d{{6}}", rf"(?:{CA_AREAS})[2-9]\d{{6}}", ()),
    ("US", "1", "", r"[2-9]\d{2}[2-9]\d{6}", r"[2-9]\d{2}[2-9]\d{6}", ((r"^1(\d{3})(\d{3})(\d{4})$", "+1 $1-$2-$3"),)),
    ("ES", "34", "", r"[89]\d{8}|6\d{8}|7[1-9]\d{7}", r"6\d{8}|7[1-9]\d{7}", ((r"^34(\d{3})(\d{2})(\d{2})(\d{2})$", "+34 $1 $2 $3 $4"),)),
    ("PE", "51", "0", r"9\d{8}|1\d{7}|(?:4[1-4]|5[1-46]|6[1-7]|7[2-46]|8[2-4])\d{6}", r"9\d{8}", (
        (r"^51(9\d{2})(\d{3})(\d{3})$", "+51 $1 $2 $3"), (r"^51(1)(\d{7})$", "+51 $1 $2"), (r"^51([4-8]\d)(\d{6})$", "+51 $1 $2"))),
    ("CO", "57", "0", r"3[0-57]\d{8}|60[1-8]\d{7}", r"3[0-57]\d{8}", ((r"^57(\d{3})(\d{7})$", "+57 $1 $2"),)),
    ("BR", "55", "0", r"(?:[14689][1-9]|2[12478]|3[1-578]|5[13-5]|7[13-579])(?:9\d{8}|[2-5]\d{7})", r"(?:[14689][1-9]|2[12478]|3[1-578]|5[13-5]|7[13-579])9\d{8}", (
        (r"^55(\d{2})(9\d{4})(\d{4})$", "+55 $1 $2-$3"), (r"^55(\d{2})(\d{4})(\d{4})$", "+55 $1 $2-$3"))),
    ("UY", "598", "0", r"9[1-9]\d{6}|[24]\d{7}", r"9[1-9]\d{6}", ((r"^598(9\d)(\d{3})(\d{3})$", "+598 $1 $2 $3"), (r"^598([24]\d{3})(\d{4})$", "+598 $1 $2"))),
    ("PY", "595", "0", r"9(?:51|6[129]|7[1-9]|8[1-8]|9[1-5])\d{6}|21\d{6,7}", r"9(?:51|6[129]|7[1-9]|8[1-8]|9[1-5])\d{6}", (
        (r"^595(9\d{2})(\d{6})$", "+595 $1 $2"), (r"^595(21)(\d{3})(\d{3,4})$", "+595 $1 $2 $3"))),
    ("BO", "591", "0", r"[67]\d{7}|[2-4]\d{7}", r"[67]\d{7}", ((r"^591([67]\d{7})$", "+591 $1"), (r"^591([2-4])(\d{7})$", "+591 $1 $2"))),
    ("EC", "593", "0", r"9\d{8}|[2-7][2-7]\d{6}", r"9\d{8}", ((r"^593(9\d)(\d{3})(\d{4})$", "+593 $1 $2 $3"), (r"^593([2-7])(\d{3})(\d{4})$", "+593 $1-$2-$3"))),
    ("VE", "58", "0", r"4(?:1[24-8]|2[246])\d{7}|2\d{9}", r"4(?:1[24-8]|2[246])\d{7}", ((r"^58(\d{3})(\d{7})$", "+58 $1-$2"),)),
    ("CR", "506", "", r"(?:5[07]|[67]\d|8[3-9])\d{6}|2[24-7]\d{6}", r"(?:5[07]|[67]\d|8[3-9])\d{6}", ((r"^506(\d{4})(\d{4})$", "+506 $1 $2"),)),
    ("PA", "507", "", r"6\d{7}|[2-57-9]\d{6}", r"6\d{7}", ((r"^507(6\d{3})(\d{4})$", "+507 $1-$2"), (r"^507(\d{3})(\d{4})$", "+507 $1-$2"))),
    ("GT", "502", "", r"[2-7]\d{7}", r"[3-5]\d{7}", ((r"^502(\d{4})(\d{4})$", "+502 $1 $2"),)),
    ("SV", "503", "", r"[267]\d{7}", r"[67]\d{7}", ((r"^503(\d{4})(\d{4})$", "+503 $1 $2"),)),
    ("HN", "504", "", r"[237-9]\d{7}", r"[37-9]\d{7}", ((r"^504(\d{4})(\d{4})$", "+504 $1-$2"),)),
    ("NI", "505", "", r"[2578]\d{7}", r"[578]\d{7}", ((r"^505(\d{4})(\d{4})$", "+505 $1 $2"),)),
    ("FR", "33", "0", r"[1-59]\d{8}|6\d{8}|7[3-9]\d{7}", r"6\d{8}|7[3-9]\d{7}", ((r"^33(\d)(\d{2})(\d{2})(\d{2})(\d{2})$", "+33 $1 $2 $3 $4 $5"),)),
    ("IT", "39", "", r"3\d{8,9}|0\d{5,10}", r"3\d{8,9}", ((r"^39(3\d{2})(\d{3})(\d{3,4})$", "+39 $1 $2 $3"), (r"^39(0[26])(\d{3,4})(\d{4})$", "+39 $1 $2 $3"))),
    ("GB", "44", "0", r"7[1-57-9]\d{8}|[12]\d{9}|3\d{9}", r"7[1-57-9]\d{8}", (
        (r"^44(7\d{3})(\d{6})$", "+44 $1 $2"), (r"^44(2\d)(\d{4})(\d{4})$", "+44 $1 $2 $3"),
        (r"^44(1\d1|11\d|3\d{2})(\d{3})(\d{4})$", "+44 $1 $2 $3"), (r"^44(1\d{3})(\d{6})$", "+44 $1 $2"))),
    ("DE", "49", "0", r"1(?:5\d{9}|[67]\d{8,9})|[2-9]\d{6,10}", r"1(?:5\d{9}|[67]\d{8,9})", (
        (r"^49(15\d{2})(\d{7})$", "+49 $1 $2"), (r"^49(1[67]\d)(\d{7,8})$", "+49 $1 $2"), (r"^49(30|40|69|89)(\d{5,9})$", "+49 $1 $2"))),
    ("PT", "351", "", r"9[1-36]\d{7}|2\d{8}", r"9[1-36]\d{7}", (
        (r"^351(2[12])(\d{3})(\d{4})$", "+351 $1 $2 $3"), (r"^351(\d{3})(\d{3})(\d{3})$", "+351 $1 $2 $3"))),
]
# FIXED VALUES: legacy marks inside a full number (code first, trunk digits already gone) and their modern form.
PHONE_REWRITES = [
    (r"^521(\d{10})$", "52$1"),
    (r"^52(?:01|04[45])(\d{10})$", "52$1"),
    (r"^549?1115(\d{8})$", "54911$1"),
    (rf"^549?({AR_AREAS})15(\d{{7}})$", "549$1$2"),
    (r"^549?([23]\d{3})15(\d{6})$", "549$1$2"),
]
