"""Word lists, labels and texts that results must reproduce.

Everything in this file is data taken over as it is, in its natural order.
"""

# Complaint labels, in the order in which an answer is searched.
TAXONOMY = [
    "Logistica_Retrasos",
    "Calidad_Producto",
    "Producto_Incorrecto_Faltante",
    "Reembolso_Atencion_Cliente",
    "Problema_Fiscal_Burocracia",
    "Otro",
]
RESIDUAL_LABEL = "Otro"

# Order in which the per-pain rankings are reported.
PAIN_ORDER = [
    "Logistica_Retrasos",
    "Producto_Incorrecto_Faltante",
    "Calidad_Producto",
    "Reembolso_Atencion_Cliente",
    "Problema_Fiscal_Burocracia",
]
DELIVERY_PAINS = ["Logistica_Retrasos", "Producto_Incorrecto_Faltante"]

# Portuguese stopwords.
STOPWORDS_PT = [
    "a", "o", "e", "de", "do", "da", "dos", "das", "um", "uma", "em", "no",
    "na", "nos", "nas", "com", "por", "para", "que", "se", "me", "te", "lhe",
    "ao", "aos", "pelo", "pela", "pelos", "pelas", "meu", "minha", "seu",
    "sua", "este", "esta", "esse", "essa", "isso", "isto", "ele", "ela",
    "eles", "elas", "eu", "tu", "nós", "vós", "mas", "ou", "quando", "como",
    "muito", "mais", "bem", "já", "ainda", "foi", "ser", "estar", "tem",
    "ter", "não", "sim", "até", "desde", "entre", "sobre", "pois", "então",
    "porque", "assim", "também", "só", "ja", "nao", "r", "q",
]

# Lexical signals that anchor each complaint label.
SIGNALS_PT = {
    "Logistica_Retrasos": [
        "entrega", "recebi", "prazo", "chegou", "correio", "transportadora",
        "nao recebi", "nao chegou", "ainda nao", "nao recebi produto",
        "ainda nao recebi", "prazo entrega", "entrega atrasada",
    ],
    "Calidad_Producto": [
        "qualidade", "defeito", "quebrado", "danificado", "pessimo",
        "qualidade pessima", "produto defeituoso", "chegou quebrado",
        "produto danificado", "qualidade produto",
    ],
    "Producto_Incorrecto_Faltante": [
        "errado", "diferente", "faltou", "incompleto", "outro produto",
        "produto errado", "veio diferente", "nao era", "produto diferente",
        "veio errado", "diferente foto",
    ],
    "Reembolso_Atencion_Cliente": [
        "reembolso", "devolucao", "atendimento", "resposta", "contato",
        "quero reembolso", "solicito devolucao", "sem resposta",
        "atendimento pessimo", "nao respondeu",
    ],
    "Problema_Fiscal_Burocracia": [
        "nota fiscal", "nfe", "imposto", "fiscal", "documento",
        "nota fiscal nao", "problema nota", "sem nota fiscal",
    ],
}

# Prompt sent with each complaint.
CLASSIFY_PROMPT = """You are a classifier. Classify this Portuguese e-commerce customer complaint into exactly one category.

Categories:
- Logistica_Retrasos: late delivery, not received, shipping delays, carrier issues
- Calidad_Producto: defective, bad quality, broken, damaged product
- Producto_Incorrecto_Faltante: wrong item sent, missing item, different from what was ordered
- Reembolso_Atencion_Cliente: refund request, no customer service response, money back
- Problema_Fiscal_Burocracia: invoice issues, nota fiscal, tax documents, billing
- Otro: anything that does not fit the above

Customer review (in Portuguese): {comment}

Reply with ONLY the category name from the list above, nothing else. Do not explain."""

# Segment names.
LOYAL_ACTIVE = "Cliente_Fiel_Activo"
LOYAL_MIDDLE = "Cliente_Fiel_Intermedio"
LOYAL_AT_RISK = "Cliente_Fiel_En_Riesgo"
SLEEPING_HIGH_VALUE = "Alto_Valor_Durmiente"
ORDINARY_SPORADIC = "Esporadico_Comun"

# Valid coordinates of the country, both ends included.
LAT_BOUNDS = (-34.0, 5.0)
LNG_BOUNDS = (-74.0, -34.0)
KM_PER_DEGREE = 111.0

# Circle radius in metres = base + share of the largest * span.
CIRCLE_BASE_M = 8000.0
CIRCLE_SPAN_M = 55000.0

# Fallback name of a product without category.
UNKNOWN_CATEGORY = "unknown_category"

# Strings that a CSV reader of the data-frame world takes as missing.
CSV_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Opening and closing text of each persona.
PERSONAS = {
    "Luna": {
        "opening": "Eres Luna, asesora de compras de la tienda. Eres directa, cercana y entusiasta — como ese amigo que siempre sabe que esta de moda y genuinamente quiere ayudarte a encontrar algo bueno, no solo venderte algo.",
        "closing": "Habla en segunda persona informal (tuteo). Tu objetivo en esta conversacion es que el cliente encuentre algo que le emocione comprar, basandote en su historial y en lo que tiene disponible en el catalogo. Si lleva tiempo sin comprar, ese es un angulo natural para la conversacion. Recomienda con criterio, no con presion.",
    },
    "Marco": {
        "opening": "Eres Marco, asesor senior de atencion al cliente. Llevas anos acompanando a clientes que tuvieron malas experiencias y sabes que lo primero que necesitan es sentirse escuchados, no recibir una oferta.",
        "closing": "Trata al cliente de usted. Antes de cualquier recomendacion, reconoce genuinamente lo que paso y ofrece una solucion concreta al problema reportado. Solo si el cliente muestra apertura, introduce productos de forma natural, priorizando los que tienen mayor volumen de ventas y menor riesgo percibido. No presiones. El objetivo de esta conversacion es recuperar la confianza, no cerrar una venta.",
    },
    "VIP": {
        "opening": "Eres el servicio de atencion premium de la tienda, reservado para clientes de alto valor. Tu comunicacion es exclusiva y anticipatoria: conoces el perfil del cliente antes de que el hable y cada recomendacion esta justificada por ese perfil especifico, no es generica.",
        "closing": "Trata al cliente de usted. Este cliente representa el segmento de mayor valor del negocio. Ofrece productos de ticket alto como primera opcion, pero con criterio: justifica la recomendacion en su historial y contexto, no solo en el precio. Si el contexto sugiere uso corporativo o compra para terceros, explora esa dimension. La conversacion debe sentirse como atencion de concierge, no como un chatbot de ventas.",
    },
}

# Headings of the rendered context.
HEADING_PROFILE = "PERFIL DEL CLIENTE:"
HEADING_CATALOG = "CATALOGO:"
HEADING_STATUS = "ESTADO DEL ULTIMO PEDIDO (via API de ordenes):"

# Header and curated texts of the knowledge base.
CATALOG_VERSION = "1.0"
CATALOG_DESCRIPTION = "Base de conocimientos simulada"
CURATED_PRODUCTS = [
    {
        "id": "PROD-001",
        "categoria": "health_beauty",
        "nombre": "Kit de Belleza y Cuidado Personal Premium",
        "descripcion": "Descubre nuestra línea premium de productos de belleza y cuidado personal. Desde skincare hidratante hasta maquillaje de larga duración, cada artículo está seleccionado para realzar tu rutina diaria de bienestar. Ideal para quienes buscan verse y sentirse bien sin salir de casa. ¡El autocuidado nunca fue tan accesible!",
        "destacado": True,
        "tags": ["belleza", "skincare", "cuidado personal", "bienestar", "salud"],
    },
    {
        "id": "PROD-002",
        "categoria": "bed_bath_table",
        "nombre": "Colección Hogar: Cama, Baño y Mesa",
        "descripcion": "Transforma cada rincón de tu hogar con nuestra colección más vendida. Sábanas de algodón suave, toallas ultra absorbentes y manteles elegantes que combinan confort y estilo. Productos pensados para hacer de tu casa un refugio acogedor. La categoría #1 en volumen de ventas por una razón: calidad que se siente desde el primer uso.",
        "destacado": True,
        "tags": ["hogar", "cama", "baño", "mesa", "decoración", "confort"],
    },
    {
        "id": "PROD-003",
        "categoria": "watches_gifts",
        "nombre": "Relojes y Regalos Exclusivos",
        "descripcion": "Encuentra el regalo perfecto en nuestra selección curada de relojes y artículos de regalo. Desde relojes clásicos hasta accesorios modernos, cada pieza está diseñada para impresionar. Con el ticket promedio más alto de nuestro catálogo, estos productos representan sofisticación y buen gusto. Perfectos para ocasiones especiales o para darte un capricho que perdure.",
        "destacado": True,
        "tags": ["relojes", "regalos", "accesorios", "lujo", "ocasiones especiales"],
    },
]
