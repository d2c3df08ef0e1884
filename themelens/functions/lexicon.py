"""Fixed values that results depend on.

Everything in this module is a constant that must equal the behaviour being
rebuilt (word lists, theme lexicon, label formats, record layout).  They are
written out plainly, in their natural order, and are only ever used as
parameters: every operator accepts its own list instead.
"""

from __future__ import annotations

# --- fixed values: generic Portuguese stop words (natural order) ---------------------------
GENERIC_STOP_WORDS = [
    "a", "ao", "aos", "aquela", "aquelas", "aquele", "aqueles", "aquilo", "as", "até", "com", "como", "da",
    "das", "de", "dela", "delas", "dele", "deles", "depois", "do", "dos", "e", "ela", "elas", "ele", "eles",
    "em", "entre", "era", "eram", "dessa", "essa", "essas", "desse", "esse", "esses", "desta", "esta", "estas",
    "deste", "este", "estes", "eu", "foi", "for", "foram", "há", "isso", "isto", "já", "mais", "mas", "me",
    "mesmo", "meu", "meus", "minha", "minhas", "muito", "na", "nas", "não", "no", "nos", "nossa", "nossas",
    "nosso", "nossos", "num", "numa", "o", "os", "ou", "para", "pela", "pelas", "pelo", "pelos", "por", "qual",
    "quando", "que", "quem", "se", "sem", "ser", "seu", "seus", "só", "sua", "suas", "também", "tambem", "te",
    "tem", "têm", "tu", "tua", "tuas", "um", "uma", "você", "vocês", "vos", "à", "às", "é", "sido", "tendo",
    "ter", "será", "está", "estão", "estar", "estou", "tinha", "tinham", "tive", "teve", "tivemos", "tiveram",
    "tenho", "tens", "temos", "sim", "cada", "mesma", "mesmas", "mesmos", "mesmo", "nela", "nele", "neles",
    "nelas", "nessa", "nesse", "nesta", "neste", "nesses", "nessas", "deste", "desta", "desses", "dessas",
    "disso", "nisso", "disto", "nisto", "lá", "aí", "ainda", "assim", "então", "depois", "antes", "sempre",
    "nunca", "vez", "vezes", "tão", "bem", "mal", "já", "logo", "ali", "cá", "onde", "sim", "não", "apesar",
    "sao", "nao",
]

# --- fixed values: academic-domain stop words (natural order) ------------------------------
DOMAIN_STOP_WORDS = [
    "sistema", "sistemas", "desenvolvimento", "projeto", "trabalho", "aplicação", "uso", "utilização",
    "utilizando", "implementação", "análise", "estudo", "pesquisa", "apresenta", "apresentar", "objetivo",
    "objetivos", "proposta", "proposto", "forma", "podem", "pode", "sendo", "partir", "tcc", "conclusão",
    "curso", "bacharelado", "artigo", "cientifico", "ifb", "instituto", "federal",
]

#: generic list followed by the domain list; duplicates are harmless (set semantics)
STOP_WORDS = GENERIC_STOP_WORDS + DOMAIN_STOP_WORDS


def distinct_stop_words(words=None) -> list[str]:
    """Distinct stop words in first-seen order."""
    return list(dict.fromkeys(STOP_WORDS if words is None else words))


# --- fixed values: theme lexicon; theme order decides ties -------------------------------
THEME_LEXICON = [
    ("Desenvolvimento Web & API", [
        "web", "api", "serviço", "rest", "front-end", "backend", "internet", "site", "online", "plataforma",
        "javascript", "css", "html", "requisição",
    ]),
    ("Ciência de Dados & I.A.", [
        "dado", "aprendizagem", "máquina", "inteligência", "artificial", "análise", "predição", "modelo",
        "rede", "neural", "algoritmo", "classificação",
    ]),
    ("Aplicações Móveis", [
        "móvel", "aplicativo", "android", "ios", "dispositivo", "celular",
    ]),
    ("Educação & Acessibilidade", [
        "educacional", "ensino", "aprendizagem", "acessibilidade", "educação", "objeto", "professor", "aluno",
        "ferramenta", "apoio",
    ]),
    ("Gestão & Processos", [
        "gestão", "processo", "gerenciamento", "controle", "monitoramento", "empresarial", "negócio", "estoque",
        "serviço",
    ]),
    ("IoT, Redes & Hardware", [
        "iot", "dispositivo", "sensor", "hardware", "monitoramento", "embarcado", "automação", "rede",
        "segurança",
    ]),
]


def theme_rows(lexicon=None) -> list[tuple[str, int, str]]:
    """(theme, theme_order, keyword) rows, keywords distinct within a theme."""
    rows = []
    for order, (theme, words) in enumerate(THEME_LEXICON if lexicon is None else lexicon):
        for w in dict.fromkeys(words.split() if isinstance(words, str) else words):
            rows.append((theme, order, w))
    return rows


# --- fixed values: naming rules ----------------------------------------------------------
NOISE_LABEL = -1
NOISE_NAME = "Ruído / Outliers"
FALLBACK_PREFIX = "Tema Geral: "
FALLBACK_SEPARATOR = ", "
MIN_THEME_SCORE = 2
NAMING_TOP_TERMS = 10
FALLBACK_TERMS = 2
MIN_CLOUD_WEIGHT = 0.01

# --- fixed values: record layout --------------------------------------------------------------
RECORD_COLUMNS = [
    "titulo", "autor", "orientador", "coorientador", "ano", "curso", "instituicao",
    "palavras_chave", "resumo", "abstract", "link_acesso", "arquivo_pdf", "tipo_trabalho",
]
#: metadata element -> record field, in the order fields are applied (later wins)
FIELD_MAP = [
    ("title", "titulo"), ("creator", "autor"), ("contributor", "orientador"),
    ("date", "ano"), ("subject", "palavras_chave"), ("description", "resumo"),
    ("abstract", "abstract"), ("advisor", "orientador"), ("co-advisor", "coorientador"),
]
FIELD_ID_PREFIX = "dublin-core-"
FIELD_VALUE_CLASS = "element-text"
MULTI_VALUE_SEPARATOR = "; "
TEXT_COLUMNS = ["titulo", "resumo", "palavras_chave"]
RESULT_COLUMNS = ["titulo", "autor", "orientador", "ano", "resumo", "palavras_chave",
                  "cluster", "cluster_name", "dim_x", "dim_y"]
ITEM_TABLE_COLUMNS = [("orientador", "Orientador"), ("autor", "Autor"), ("ano", "Ano"),
                      ("titulo", "Título do TCC"), ("cluster_name", "Tema (Cluster)")]
ITEM_TABLE_ORDER = ["Tema (Cluster)", "Ano", "Orientador"]

# --- fixed values: harvest ------------------------------------------------------------------
ITEM_LINK_PATTERNS = [r"/items/show/\d+", r"/item/\d+", r"/items/\d+"]
ITEM_HOST_TOKEN = "omeka"
ITEM_PATH_TOKEN = "/items/show/"
ATTACHMENT_TOKEN = ".pdf"
MIN_BODY_BYTES = 100
TITLE_FALLBACK_TAGS = ["h1.item-title", "h1", "title"]
MIN_TEXT_CHARS = 50
PREVIEW_ROWS = 3
PREVIEW_CHARS = 100
