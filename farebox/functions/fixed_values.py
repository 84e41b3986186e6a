"""Names, texts and thresholds that results must carry verbatim."""

# Columns of the purchases table, in file order.
PURCHASE_COLUMNS = [
    "nk_ota_localizer_id",
    "fk_contact",
    "date_purchase",
    "time_purchase",
    "place_origin_departure",
    "place_destination_departure",
    "place_origin_return",
    "place_destination_return",
    "fk_departure_ota_bus_company",
    "fk_return_ota_bus_company",
    "gmv_success",
    "total_tickets_quantity_success",
]

# Those that hold keys, places and markers rather than dates or numbers.
TEXT_COLUMNS = [
    "nk_ota_localizer_id",
    "fk_contact",
    "place_origin_departure",
    "place_destination_departure",
    "place_origin_return",
    "place_destination_return",
    "fk_departure_ota_bus_company",
    "fk_return_ota_bus_company",
]

# Other spellings under which the tickets column may arrive.
TICKETS_COLUMN_NAMES = [
    "total_tickets_quantity_sucess",
    "total_tickets_quantity_success",
    "tickets",
    "qtd_passagens",
]

# Texts that stand for a missing value in CSV files.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Markers of "no return trip" in the place and company columns.
NO_RETURN_PLACE = "0"
NO_RETURN_COMPANY = "1"

ROUTE_SEPARATOR = " -> "

# Weekday names, Monday first.
WEEKDAYS_EN = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKDAYS_PT = ["Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado", "Domingo"]

# Month names, January first.
MONTHS_EN = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
MONTHS_PT = [
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho",
    "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
]

# Answers when there is no purchase to take a best weekday or hour from.
FALLBACK_WEEKDAY_PT = "Segunda"
FALLBACK_HOUR = 12

# Customer segments with their description and recommended strategies.
SEGMENT_STRATEGIES = {
    "Campeões": (
        "Clientes de alto valor que compram com frequência e recentemente.",
        [
            "🌟 Programe de fidelidade exclusivo",
            "🎁 Descontos especiais para destinos premium",
            "✉️ Comunicação prioritária sobre novos destinos e serviços",
            "📊 Monitorar de perto para evitar churn",
        ],
    ),
    "Leais": (
        "Clientes frequentes que não compraram tão recentemente.",
        [
            '🎯 Ofertas "Volte e Ganhe" para estimular nova compra',
            '👫 Programa "Indique um Amigo"',
            "🔄 Cupons para aumentar frequência",
            "🎫 Descontos em destinos já visitados",
        ],
    ),
    "Potenciais": (
        "Compraram recentemente com valor alto, mas pouca frequência.",
        [
            "📆 Incentivos para compras sazonais (feriados, férias)",
            "🚌 Cross-selling de destinos complementares",
            "🎟️ Programa de pacotes com desconto progressivo",
            "📱 Alertas para destinos populares",
        ],
    ),
    "Em Risco": (
        "Bons clientes que não compram há algum tempo.",
        [
            "🚨 Campanha de reativação urgente",
            "💰 Ofertas substanciais para retorno",
            "📞 Contato personalizado",
            "📊 Pesquisa sobre motivos do afastamento",
        ],
    ),
    "Hibernando": (
        "Não compram há tempo e estão ficando inativos.",
        [
            "🔥 Promoções fortes de reativação",
            "🆕 Comunicação sobre novos serviços e melhorias",
            "🎯 Ofertas baseadas em histórico anterior",
            '✉️ Campanha "Sentimos sua Falta"',
        ],
    ),
    "Precisam Atenção": (
        "Recentes, mas baixa frequência e valor.",
        [
            "📈 Incentivos para aumento de ticket médio",
            "⭐ Comunicação sobre benefícios premium",
            "🚌 Recomendações personalizadas de rotas",
            "🎁 Programa de recompensas por gastos",
        ],
    ),
    "Novos": (
        "Primeira compra recente.",
        [
            "👋 Jornada de boas-vindas personalizada",
            "🎁 Oferta especial para segunda compra",
            "📱 Incentivo para download do aplicativo",
            "🔍 Pesquisa de satisfação pós-compra",
        ],
    ),
    "Perdidos": (
        "Baixo engajamento, sem compras recentes.",
        [
            '🔄 Campanha "Última Chance"',
            "💸 Desconto radical para reativação",
            "📊 Reduzir frequência de comunicação",
            "🔎 Análise para entender abandono",
        ],
    ),
}
OTHER_SEGMENT = "Outros"

# Segments shown in the first (blue) priority group; all others are orange.
BLUE_SEGMENTS = ["Campeões", "Leais", "Potenciais", "Novos"]

# Contact strategy by probability of the best window: above 0.7, above 0.4, else.
STRATEGY_ABOVE_070 = "Oferta agressiva com prazo limitado"
STRATEGY_ABOVE_040 = "Lembrete personalizado com benefícios"
STRATEGY_OTHERWISE = "Comunicação informativa e sem pressão"

# Probability colour: above 0.6, above 0.3, else.
BAND_ABOVE_060 = "green"
BAND_ABOVE_030 = "orange"
BAND_OTHERWISE = "red"

# Repurchase horizons in days.
HORIZONS = [7, 15, 30]

# Forest settings: (trees, depth, minimum rows per leaf), seed and the split.
REPURCHASE_FOREST = {"trees": 50, "depth": 5, "min_leaf": 5}
ROUTE_FOREST = {"trees": 50, "depth": 10, "min_leaf": 5}
EARLY_REPURCHASE_FOREST = {"trees": 100, "depth": 30, "min_leaf": 1}
SEED = 42
TRAIN_PERCENT = 80

# Minimum data for a dependable model.
MIN_LABELLED_ROWS = 100
MIN_ROUTE_CUSTOMERS = 50

TOP_ROUTES = 10
