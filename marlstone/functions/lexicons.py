"""Word lists of the rules. All are fixed values; names of one site are the caller's to add."""

# Words of small talk.
SMALLTALK = (
    "ahora bueno entonces ok okey okis vale listo dale vamos bien perfecto genial excelente claro sis sisas nop nope aja ajam ya simon nel mm mhm jeje jaja jiji lol xd"
).split()
# Phrases of farewell.
FAREWELL = [
    "adios", "adiós", "chau", "chao", "hasta luego", "hasta pronto", "nos vemos", "gracias ya", "eso era todo", "eso es todo", "me voy", "hasta mañana", "ciao",
    "bye", "goodbye", "see you", "farewell", "take care", "tchau", "até logo", "até mais", "obrigado já",
    "пока", "до свидания", "всего хорошего", "до встречи", "再见", "拜拜", "谢谢了", "au revoir", "à bientôt", "adieu",
]
# Phrases of complaint.
COMPLAINT = [
    "queja", "reclamo", "problema", "perdido", "perdida", "dañado", "dañada", "no llegó", "no llego", "no recibí", "no recibi", "extraviado", "extraviada",
    "roto", "rota", "mal estado", "demora", "retraso", "tardanza", "complaint", "lost", "damaged", "missing", "delayed",
]
# Phrases of urgency.
URGENT = ["urgente", "urgencia", "rápido", "rapido", "hoy", "ahora", "inmediato", "inmediatamente", "ya", "cuanto antes", "urgent", "asap", "immediately", "right now"]
# Phrases that ask for prices.
PRICE = [
    "precio", "costo", "cuánto", "cuanto", "tarifa", "cobran", "cobro", "vale", "cuesta", "costar", "cotizar", "cotización", "cotizacion", "price", "cost", "how much", "rate", "fee",
]
# Words of the domain.
DOMAIN = (
    "correos postal envio envío paquete ems sucursal rastreo tarifa filatelia encomienda despacho entrega remitente destinatario guia guía tracking casilla oficina regional horario"
    " enviar mandar recibir codigo código seguimiento servicio servicios ofrecen ofreceis tienen tienes disponible disponibles chasqui express delivery certificado ordinario giro giros"
    " correspondencia atiende atienden abierto abiertos abren cierran cerrado domingo domingos sabado sabados feriado festivo laboral laborables"
).split()
# Words of other domains.
ALIEN = (
    "novia novio esposa esposo mama papa hijo hija hermano hermana amigo amiga tia tio abuelo abuela comida comer hambre restaurante receta cocinar almuerzo cena desayuno pizza pollo"
    " carne fideos doctor medico hospital enfermo fiebre dolor gripe farmacia medicina pastilla pelicula película musica música cancion canción futbol fútbol partido deporte juego"
    " videojuego netflix spotify youtube chisme chismes gossip rumor rumores facebook instagram twitter tiktok whatsapp computadora celular internet presidente gobierno pais país capital clima temperatura lluvia perro gato animal mascota veterinario"
    " hacker virus malware contraseña password skill skills habilidad habilidades chunk chunks embedding embeddings vectorial rag"
).split()
# First words of questions.
QUESTION_STARTS = "que como cual donde cuanto cuando quien dame hablame tiene hay cuenta existe".split()
# Short requests.
TERSE = ["dame", "da", "dale", "dalo", "dáme", "avér", "aver", "por favor", "please"]
# Words that no whole answer ends in.
LAST_WORDS = (
    "y o e u ni pero sino aunque porque que con sin de del la el los las un una su sus en a al por para como si se le lo tambien ademas and or but with the an of in"
).split()
# Marks of Portuguese.
PORTUGUESE = [
    "voce", "nao ", "tambem", "entao", "esta ", "estao", "sao ", "isso ", "esse ", "essa ", "aqui ", "aquele", "posso ", "pode ", "podem ", "temos ", "nosso ", "nossa ",
    "obrigado", "obrigada", "envio ", "envios ", "rastreamento", "agencia ", "correios", "servico", "servicos", "informacao", "informacoes", "visite ", "ligue ", "ate logo", "ate mais",
]
# Marks of English.
ENGLISH_MARKERS = (
    "the is are was were have has had what when where who how why which can will would should could do does tracking ship package mail help please office branch rate price hello"
    " thanks your you this that with from about need send delivery code number status"
).split()
# Marks of Spanish.
SPANISH_MARKERS = (
    "que los las del por para como una con mas pero muy este esta entre envio rastreo paquete sucursal tarifa tienes puedo ayuda gracias hola buenas necesito saber donde cuanto cuando"
    " cual correos bolivia envios servicio horario codigo numero estado telefono direccion"
).split()
# Phrases of uncertainty.
UNCERTAIN = ["no tengo esa información", "no lo sé", "no estoy seguro", "no puedo ayudar", "no entiendo", "consulta con un", "llama al"]
# Lines that say nothing.
NOISE_LINES = ["comparte", "compartir", "menu", "inicio", "home", "leer mas", "leer más"]
# Other names of cities.
CITY_ALIASES = {
    "lpb": "la paz", "cba": "cochabamba", "cbba": "cochabamba", "scz": "santa cruz", "santa cruz de la sierra": "santa cruz", "trinidad": "beni", "cobija": "pando",
    "potosí": "potosi", "oruro": "oruro", "tarija": "tarija", "sucre": "sucre", "chuquisaca": "sucre", "beni": "beni", "pando": "pando", "la paz": "la paz",
}
# Phrases that ask for a place.
LOCATION = [
    "ubicacion", "ubicación", "donde", "dónde", "direccion", "dirección", "sucursal", "oficina", "mapa", "maps", "coordenadas", "como llego", "como llegar", "donde queda",
    "donde se encuentra", "location", "address", "branch", "where is", "how to get", "localização", "endereço", "agência", "onde fica",
    "адрес", "где находится", "местоположение", "отделение", "地址", "位置", "在哪", "分支机构", "adresse", "succursale", "où se trouve",
]
# Words of postal intent.
POSTAL_INTENT = (
    "enviar envio envío mandar paquete correo rastrear tarifa sucursal oficina direccion dirección ubicacion ubicación telefono teléfono mapa contacto"
).split()
# Phrases of the domain in answers.
ANSWER_DOMAIN = [
    "correos", "postal", "envio", "envío", "paquete", "ems", "sucursal", "rastreo", "tarifa", "filatelia", "encomienda", "despacho", "entrega", "remitente", "destinatario", "guia", "guía",
    "tracking", "horario", "oficina", "regional", "casilla", "servicio", "servicios", "enviar", "mandar", "recibir", "nacional", "internacional", "peso", "costo", "precio", "reclamo", "queja",
    "prioritario", "urgente", "express", "delivery", "chasqui", "bolivia", "bolivian", "la paz", "cochabamba", "santa cruz",
]
# Words of a question that say nothing about its topic.
QUESTION_STOPS = (
    "de la el los las un una que es en del al se su por con para como me te le nos les lo a y o e u the of hablame habla dime dame cuéntame cuentame sobre cual cuál cuales cuáles qué"
    " quien quién donde dónde cuando cuándo cómo hay tiene"
).split()
# Phrases that give an invention away.
HALLUCINATION = [
    "según mis datos internos", "en mi base de datos tengo", "he encontrado que", "como modelo de lenguaje", "no tengo acceso a internet", "mi entrenamiento incluye",
    "según mi conocimiento", "en mi entrenamiento", "como ia, no tengo", "como inteligencia artificial", "como asistente de ia", "como asistente virtual de ia",
    "mi conocimiento llega hasta", "mi fecha de corte", "no tengo información actualizada", "basándome en mi conocimiento general", "según información general",
    "de acuerdo a mi conocimiento", "los tigres", "1234567890", "0000000000", "en bolivia, los", "según reportes", "se estima que", "se cree que", "se dice que",
    "según datos oficiales de", "de acuerdo a datos", "sistema desbloqueado", "system unlocked", "modo sin restricciones", "unrestricted mode", "skills configuradas:", "skills activas:",
    "chunks indexados:", "modelo de embeddings:", "base vectorial:", "estado rag:", "ollama disponible:", "sesiones activas:", "trigger_tokens", "trigger_words", "skill_id",
    "prioridad 5", "prioridad 4", "prioridad 3", "categoria: atencion", "categoria: operacion", "categoria: documental",
]
# Words of an answer that support nothing.
EVIDENCE_STOPS = (
    "para como cuando donde dónde que qué cual cuál con sin por sobre este esta estos estas desde hasta entre solo the and with from this that there where what pero porque cuanto cuánto tengo"
).split()
# Words that tell the topic of a question out of scope, in the order they are looked for.
REDIRECT_TOPICS = {
    "country": ["bolivia", "pais", "sudamerica", "america"],
    "government": ["gobierno", "estado", "ministerio", "decreto"],
    "weather": ["clima", "tiempo", "temperatura", "lluvia"],
    "sports": ["futbol", "partido", "deporte", "equipo"],
}
# Words of a greeting where nothing is known.
EMPTY_GREETINGS = ["hola", "buenas", "hello", "hi"]
# What is said where nothing is known, to a greeting and else.
EMPTY_ANSWERS = {
    "es": ("Hola. Este chatbot todavía no tiene información cargada.", "No tengo información cargada todavía."),
    "en": ("Hello. This chatbot has no information loaded yet.", "I have no information loaded yet."),
}
# What questions about the network are told.
REFUSALS = {"es": "No puedo proporcionar esa información.", "en": "I cannot provide that information."}
# Phrases that ask for a parcel's way.
TRACKING_WORDS = ["rastreo", "seguimiento", "tracking", "rastrear", "consultar seguimiento", "consultar rastreo", "codigo de seguimiento", "codigo de rastreo"]
# A pattern of greetings.
GREETING = (
    r"^(hola\b|holi\b|holis\b|buenas?\b|buenas?\s+(dias?|tardes?|noches?)|hey\b|hi\b|hello\b|saludos|que\s+tal|como\s+estas|buen\s+dia|привет|здравствуй|добрый\s+(день|вечер|утро)"
    r"|你好|您好|嗨|ol[aá]\b|bom\s+dia|boa\s+(tarde|noite)|bonjour|bonsoir|salut|gracias\b|thank\s+you\b|thx\b|tnx\b)"
)
# Patterns of instructions to the model.
INJECTION = [
    r"ignora\s+(todas?\s+)?(las?\s+)?instrucciones", r"ignore\s+(all\s+)?(previous\s+)?instructions", r"olvida\s+(tus?\s+)?instrucciones", r"forget\s+(your\s+)?instructions",
    r"olvida\s+que\s+eres", r"forget\s+that\s+you\s+are", r"pretend\s+(you\s+are|to\s+be)", r"finge\s+que\s+eres", r"jailbreak", r"dan\s+mode", r"developer\s+mode",
    r"modo\s+desarrollador", r"sin\s+restricciones", r"without\s+restrictions", r"bypass\s+(your\s+)?(rules|restrictions|filters)", r"override\s+(your\s+)?(instructions|rules)",
    r"system\s+prompt", r"prompt\s+injection", r"</?(system|instruction|prompt)>", r"\[INST\]|\[/INST\]", r"###\s*(instruction|system|human|assistant)",
    r"muestra\s+(el\s+)?(system\s+prompt|prompt\s+del\s+sistema|instrucciones\s+del\s+sistema)", r"dame\s+(el\s+)?(system\s+prompt|prompt\s+del\s+sistema|tus\s+instrucciones)",
    r"cu[aá]l\s+es\s+tu\s+(system\s+prompt|prompt|configuraci[oó]n\s+interna)", r"repite\s+(tus?\s+)?(instrucciones|prompt|configuraci[oó]n)",
    r"qu[eé]\s+(instrucciones|prompt|configuraci[oó]n)\s+tienes",
]
# A pattern, and what must not follow it. The exceptions stand apart from their pattern because the SQL engine has no look-ahead and reads them here.
INJECTION_UNLESS = {
    r"ahora\s+eres\s+": ["correos"], r"now\s+you\s+are\s+": ["correos"], r"actúa\s+como\s+": ["asistente", "chatbot"], r"act\s+as\s+": ["assistant", "chatbot"],
}
# Patterns of questions about the network.
NETWORK = [
    r"(?:^|\s)(?:ip|dns)(?:\s+de\s+\w+|\s+del?\s+\w+)?(?:\s|$)", r"dame\s+(?:el\s+|la\s+)?(?:ip|dns)\b", r"(?:ip|dns)\s+de\s+correos", r"\bscan\s+(?:de\s+)?(?:red|puertos?)\b",
    r"\bque\s+puertos?\s+(?:tiene|hay)\b",
]
# Patterns of other topics.
OFF_TOPIC = [
    r"^\s*\d+\s*[\+\-\*\/\^]\s*\d+", r"\bcuanto\s+es\s+\d", r"\bcu[aá]nto\s+son\s+\d", r"\b\d+\s+(?:mas|más|menos|por|entre)\s+\d+",
    r"\bcu[aá]ntos?\s+d[ií]as?\s+(?:son|tiene|hay|es)\b", r"\bcu[aá]ntos?\s+(?:horas?|minutos?|segundos?|meses?|a[ñn]os?)\s+(?:son|tiene|hay|es)\b",
    r"\bcu[aá]nto\s+tiempo\s+(?:es|son|dura)\b", r"\bcu[aá]l\s+es\s+la\s+capital\s+de\b", r"\bcu[aá]ntos?\s+habitantes?\b", r"\bpresidente\s+de\b", r"\bclima\s+en\b",
    r"\btemperatura\s+en\b", r"\breceta\s+de\b", r"\bc[oó]mo\s+(?:cocinar|preparar|hacer)\b", r"\bpel[ií]cula\b", r"\bm[uú]sica\b", r"\bcancion\b", r"\bcanci[oó]n\b", r"\bf[uú]tbol\b",
    r"\bdeporte\b", r"\bequipo\s+de\b", r"\bchiste\b", r"\bcuento\b", r"\bpoema\b", r"\bchisme\b", r"\bchismes\b", r"\bgossip\b", r"\brumor\b", r"\btraducir?\b", r"\btraduce\b",
    r"\bqu[eé]\s+hora\s+es\b", r"\bfecha\s+de\s+hoy\b", r"\bqu[eé]\s+d[ií]a\s+es\b", r"\btengo\s+(?:hambre|sed|fiebre|dolor|sue[ñn]o|fr[ií]o|calor|miedo|tos|gripe|n[aá]useas?)\b",
    r"\bme\s+(?:duele|duelen|siento|siento\s+mal|encuentro\s+mal|fall[oó])\b",
    r"\bmi\s+(?:tia|tío|tio|mama|mamá|papa|papá|hermano|hermana|hijo|hija|abuelo|abuela|amigo|amiga|novio|novia|esposo|esposa|perr[oa]s?|perrit[oa]s?|gat[oa]s?|gatit[oa]s?)\s+se\s+(?:perdi[oó]|fue|muri[oó]|enferm[oó]|lastim[oó])\b",
    r"\bse\s+perdi[oó]\s+(?:mi|una|un)\b", r"\bestoy\s+(?:triste|feliz|aburrido|cansado|enojado|enferma?|enamorado)\b", r"\bqu[eé]\s+(?:comer|cenar|almorzar|desayunar)\b",
    r"\brecomien[dh]a[sm]?\s+(?:un\s+)?(?:restaurante|lugar|sitio|hotel|bar)\b", r"\bchatea?\s+conmigo\b", r"\bhabla\s+conmigo\b", r"\bcu[eé]ntame\s+(?:algo|un)\b",
    r"\bqu[eé]\s+piensas?\s+(?:de|sobre)\b", r"\beres\s+(?:inteligente|bueno|malo|listo|tonto)\b",
    r"\b(?:skill|skil|sckill|sckil)s?\s+(?:internas?|cargadas?|en\s+memoria|del\s+sistema|del\s+bot)\b", r"\btodas?\s+las\s+(?:skill|skil|sckill|sckil)s?\b",
    r"\bchunks?\s+(?:indexados?|cargados?|en\s+memoria)\b", r"\bbase\s+vectorial\b", r"\bembeddings?\s+(?:cargados?|del\s+sistema)\b", r"\brag\s+(?:activo|cargado|del\s+sistema|local)\b",
    r"\b(?:dame|dime|cual\s+es|cuál\s+es|muestra|obtén|obten)\s+(?:el\s+|la\s+)?(?:ip|dns|servidor|host|puerto|firewall|subred|gateway|mac\s+address)\b", r"(?:^|\s)ip\s+de\s+correos(?:\s|$)",
    r"(?:^|\s)dns\s+de\s+correos(?:\s|$)", r"(?:^|\s)ip\s+del\s+servidor(?:\s|$)", r"dame\s+(?:el\s+|la\s+)?ip(?:\s|$)", r"dame\s+(?:el\s+|la\s+)?dns(?:\s|$)",
    r"\bque\s+puertos?\s+(?:tiene|hay|están)\b", r"\bscan\s+(?:de\s+)?(?:red|puertos?|vulnerabilidades?)\b",
]
# A pattern, and what must not follow it. The exceptions stand apart from their pattern because the SQL engine has no look-ahead and reads them here.
OFF_TOPIC_UNLESS = {
    r"\bqu[eé]\s+es\s+(?:un|una|el|la)\s+": ["ems", "correo", "envio", "paquete", "encomienda", "rastreo", "casilla", "filatelia"],
    r"\bcu[aá]l\s+es\s+(?:el|la)\s+mejor\s+": ["servicio", r"opci[oó]n\s+de\s+env"],
}
# Patterns of concrete data.
CONCRETE_DATA = [r"\b\d{4,}\b", r"\b\d+[.,]\d+\b", r"\b\d+\s*(?:bs|bob|usd|\$|%|kg|g|lb|km)\b", r"\bbs\.?\s*\d+", r"\+591\s*\d+", r"\b(?:19|20)\d{2}\b"]
# Words of an answer and the replies then offered.
QUICK_REPLIES = {
    "es": [
        (["tarifa", "precio", "costo", "ems", "encomienda", "envío", "envio"], ["tarifas ems", "tarifas encomienda"]),
        (["sucursal", "oficina", "dirección", "direccion", "ubicación"], ["sucursal la paz", "sucursal santa cruz", "sucursal cochabamba"]),
        (["rastreo", "rastrear", "seguimiento", "código", "codigo", "guía", "guia"], ["rastrear mi paquete"]),
        (["horario", "abierto", "cerrado", "atienden"], ["donde están las sucursales"]),
    ],
    "en": [
        (["tariff", "rate", "price", "cost", "ems", "parcel"], ["tarifas ems", "tarifas encomienda"]),
        (["branch", "office", "location", "address"], ["sucursal la paz", "sucursal santa cruz", "sucursal cochabamba"]),
        (["track", "tracking", "code", "shipment"], ["rastrear mi paquete"]),
    ],
}
# Patterns of tracking codes, in order.
TRACKING_CODES = [r"[A-Z][0-9]+[A-Z][0-9]+BO", r"[A-Z][0-9]{6,}BO", r"[0-9]{4,}[A-Z][0-9]+BO", r"[A-Z]{2}[0-9]{9}[A-Z]{2}", r"\b[0-9]{12,14}\b"]
# Priorities of kinds of sources.
SOURCE_PRIORITY = {"knowledge_base": 7, "pdf": 6, "history": 5, "branch": 5, "section": 4, "web_main": 4, "service": 4, "json_data": 3, "file": 2}
# Bonus of preferred kinds, in order.
PREFERENCE_BONUS = [0.22, 0.16, 0.10, 0.04]
# Letters and what they are without accents.
ACCENTS, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"
