"""Fixed values.

Everything in this file is domain data whose spelling decides the result: labels, name tables,
header spellings, thresholds and coordinates.
"""

# --- Fixed values: ordinals of administrative levels and issuer ratings ---------------------------
LEVEL_RANK = {
    "省级": 7,
    "省(开发区)级": 6,
    "地市级": 5,
    "国家新区级": 4,
    "地市(开发区)级": 3,
    "区县(开发区)级": 2,
    "区县级": 1,
}
RATING_RANK = {"AAA": 5, "AA+": 4, "AA": 3, "AA-": 2, "A+": 1, "A": 0}
LEVEL_SUFFIX = "级"
PROVINCE_LEVEL = "省级"

# --- Fixed values: fiscal bands, upper bound exclusive, in 100 M CNY -------------------------------
FISCAL_BANDS = [
    ("0-100亿", 100),
    ("100-200亿", 200),
    ("200-300亿", 300),
    ("300-500亿", 500),
    ("500-700亿", 700),
    ("700-1000亿", 1000),
]
TOP_FISCAL_BAND = "1000亿以上"
UNKNOWN_FISCAL_BAND = "财力未知"

# --- Fixed values: agency names (any known spelling -> full name) ----------------------------------
AGENCY_NAMES = {
    "联合资信评估股份有限公司": "联合资信评估股份有限公司",
    "联合信用评级有限公司": "联合资信评估股份有限公司",
    "联合资信": "联合资信评估股份有限公司",
    "大公国际资信评估有限公司": "大公国际资信评估有限公司",
    "大公国际": "大公国际资信评估有限公司",
    "中诚信国际信用评级有限责任公司": "中诚信国际信用评级有限责任公司",
    "中诚信国际信用评级有限公司": "中诚信国际信用评级有限责任公司",
    "中诚信国际": "中诚信国际信用评级有限责任公司",
    "鹏元资信评估有限公司": "鹏元资信评估有限公司",
    "中证鹏元资信评估股份有限公司": "中证鹏元资信评估股份有限公司",
    "鹏元资信": "鹏元资信评估有限公司",
    "东方金诚国际信用评估有限公司": "东方金诚国际信用评估有限公司",
    "东方金诚": "东方金诚国际信用评估有限公司",
    "上海新世纪资信评估投资服务有限公司": "上海新世纪资信评估投资服务有限公司",
    "上海新世纪": "上海新世纪资信评估投资服务有限公司",
    "远东资信评估有限公司": "远东资信评估有限公司",
    "远东资信": "远东资信评估有限公司",
    "大普信用评估有限公司": "大普信用评估有限公司",
    "大普信用": "大普信用评估有限公司",
    "惠誉博华信用评级有限公司": "惠誉博华信用评级有限公司",
    "惠誉博华": "惠誉博华信用评级有限公司",
}

# --- Fixed values: display names (full name -> short name) -----------------------------------------
AGENCY_SHORT_NAMES = {
    "联合资信评估股份有限公司": "联合资信",
    "大公国际资信评估有限公司": "大公国际",
    "中诚信国际信用评级有限责任公司": "中诚信国际",
    "鹏元资信评估有限公司": "鹏元资信",
    "东方金诚国际信用评估有限公司": "东方金诚",
    "上海新世纪资信评估投资服务有限公司": "上海新世纪",
    "远东资信评估有限公司": "远东资信",
    "大普信用评估有限公司": "大普信用",
    "中证鹏元资信评估股份有限公司": "中证鹏元",
    "惠誉博华信用评级有限公司": "惠誉博华",
}
LONG_CITY_NAMES = ["攀枝花", "西双版纳", "呼和浩特", "大兴安岭", "鄂尔多斯"]

# --- Fixed values: source headers per column, first one present wins -------------------------------
BOND_HEADERS = {
    "security_code": ["证券代码"],
    "security_name": ["证券简称"],
    "issuer": ["发行人中文名称"],
    "issuer_short": ["发行人中文简称"],
    "province": ["省份"],
    "city": ["城市"],
    "admin_level": ["城投行政级别(Wind)", "城投行政级别（Wind）", "城投行政级别"],
    "underwriters": ["主承销商"],
    "bond_class": ["Wind债券二级分类"],
    "issue_amount": ["发行总额\n[单位] 亿元", "发行总额(亿元)", "发行总额 亿元"],
    "coupon": ["票面利率(发行时)\n[单位] %", "票面利率(发行时) %"],
    "rating": [
        "主体评级\n[交易日期] 最新收盘日\n[评级机构] 国内评级机构(除中债资信)\n[评级对象类型] 主体信用评级",
        "主体评级",
    ],
    "issuer_agency": [
        "主体评级评级机构\n[交易日期] 最新收盘日\n[评级对象类型] 主体信用评级\n[评级机构] 国内评级机构(除中债资信)",
        "主体评级机构",
    ],
    "bond_rating": [
        "债项评级\n[交易日期] 最新收盘日\n[评级机构] 国内评级机构(除中债资信)",
        "最新债项评级",
    ],
    "bond_agency": [
        "债项评级机构\n[交易日期] 最新收盘日\n[评级机构] 国内评级机构(除中债资信)",
        "债项评级机构",
    ],
    "total_assets": ["资产总计\n[报告期] 去年三季\n[报表类型] 合并报表\n[单位] 亿元", "总资产 亿元"],
    "net_assets": ["所有者权益合计\n[报告期] 去年三季\n[报表类型] 合并报表\n[单位] 亿元", "所有者权益 亿元"],
    "revenue": ["营业收入\n[报告期] 去年三季\n[报表类型] 合并报表\n[单位] 亿元", "营业收入 亿元"],
    "net_profit": ["净利润\n[报告期] 去年三季\n[报表类型] 合并报表\n[单位] 亿元", "净利润 亿元"],
    "leverage": ["资产负债率\n[报告期] 去年三季\n[单位] %", "资产负债率 %"],
    "report_date": ["最新报告期\n[交易日期] 最新收盘日", "财务最新报告期"],
    "controller": ["实际控制人名称\n[日期] 2022-12-31", "实际控制人"],
}
CITY_HEADER_PARTS = ["地区", "城市"]
REVENUE_HEADER_PARTS = ["一般公共预算收入"]

# --- Fixed values: quality thresholds and column lists ---------------------------------------------
REQUIRED_BOND_COLUMNS = [
    "security_code", "security_name", "issuer", "province", "city", "rating", "issuer_agency", "admin_level",
]
CRITICAL_BOND_COLUMNS = ["issuer", "province", "city"]
CRITICAL_NULL_LIMIT = 0.02
WATCHED_BOND_COLUMNS = [
    "rating", "issuer_agency", "total_assets", "net_assets", "revenue", "net_profit", "leverage",
]
WATCHED_NULL_LIMIT = 0.80
JOIN_GROWTH_LIMIT = 1.01
JOIN_MATCH_LIMIT = 0.80
PLATFORM_QUANTILE = 0.50

# --- Fixed values: labels of results ---------------------------------------------------------------
UNKNOWN_PROVINCE = "未知"
UNKNOWN_CITY = "未知城市"
UNKNOWN_LEVEL = "未知级别"
UNKNOWN_RATING = "未知评级"
UNKNOWN_AGENCY = "未知评级机构"
NO_RATING = "未知"
ALL = "全部"
LIST_MARK = "、"
MAIN_PARTNER = "主要合作伙伴"
FIRST_CONTACT = "初步合作对象"
UNDEVELOPED = "待开拓合作关系"
MAIN_PARTNER_AT = 3
FIRST_CONTACT_AT = 1
ACCEPT, CAUTION, DECLINE = "建议承做", "谨慎评估", "暂不建议"
ACCEPT_AT, CAUTION_AT = 0.65, 0.35
METRICS = ["total_assets", "net_assets", "revenue", "net_profit", "leverage"]
DEFAULT_MAP_CENTRE = (104.0, 30.0)

# --- Fixed values: city coordinates (city -> longitude, latitude) ----------------------------------
CITY_COORDS = {
    "成都市": (104.07, 30.67), "绵阳市": (104.68, 31.47), "宜宾市": (104.62, 28.77),
    "泸州市": (105.43, 28.87), "南充市": (106.08, 30.79), "达州市": (107.47, 31.22),
    "乐山市": (103.76, 29.58), "遂宁市": (105.57, 30.52), "德阳市": (104.40, 31.13),
    "自贡市": (104.77, 29.35), "内江市": (105.07, 29.59), "眉山市": (103.83, 30.05),
    "广安市": (106.63, 30.47), "广元市": (105.84, 32.43), "攀枝花市": (101.72, 26.58),
    "雅安市": (103.01, 30.01), "资阳市": (104.63, 30.13), "凉山彝族自治州": (102.27, 27.90),
    "巴中市": (106.74, 31.85), "甘孜藏族自治州": (101.97, 30.05), "阿坝藏族羌族自治州": (102.22, 31.90),
    "济南市": (117.00, 36.67), "青岛市": (120.38, 36.07), "烟台市": (121.39, 37.54),
    "潍坊市": (119.16, 36.71), "临沂市": (118.36, 35.06), "济宁市": (116.59, 35.41),
    "淄博市": (118.05, 36.81), "泰安市": (117.09, 36.19), "威海市": (122.12, 37.51),
    "菏泽市": (115.46, 35.23), "聊城市": (115.97, 36.46), "日照市": (119.46, 35.42),
    "枣庄市": (117.32, 34.81), "东营市": (118.67, 37.43), "滨州市": (117.97, 37.38),
    "德州市": (116.29, 37.45),
    "南京市": (118.78, 32.04), "苏州市": (120.62, 31.32), "无锡市": (120.30, 31.57),
    "南通市": (120.86, 32.01), "常州市": (119.97, 31.79), "徐州市": (117.18, 34.27),
    "扬州市": (119.41, 32.39), "泰州市": (119.90, 32.46), "镇江市": (119.44, 32.20),
    "淮安市": (119.02, 33.60), "盐城市": (120.16, 33.35), "连云港市": (119.22, 34.60),
    "宿迁市": (118.28, 33.96),
    "杭州市": (120.15, 30.28), "宁波市": (121.55, 29.87), "温州市": (120.67, 28.00),
    "绍兴市": (120.58, 30.03), "金华市": (119.65, 29.08), "台州市": (121.42, 28.66),
    "嘉兴市": (120.76, 30.77), "湖州市": (120.10, 30.87), "衢州市": (118.87, 28.97),
    "舟山市": (122.21, 29.99), "丽水市": (119.92, 28.47),
    "广州市": (113.26, 23.13), "深圳市": (114.06, 22.54), "东莞市": (113.75, 23.05),
    "佛山市": (113.12, 23.02), "中山市": (113.39, 22.52), "珠海市": (113.58, 22.27),
    "惠州市": (114.41, 23.11), "汕头市": (116.68, 23.35), "韶关市": (113.59, 24.80),
    "江门市": (113.08, 22.58), "湛江市": (110.36, 21.27), "茂名市": (110.93, 21.66),
    "昆明市": (102.71, 25.04), "曲靖市": (103.80, 25.49), "玉溪市": (102.55, 24.35),
    "保山市": (99.17, 25.11), "昭通市": (103.72, 27.34), "丽江市": (100.23, 26.87),
    "普洱市": (100.97, 22.79), "临沧市": (100.08, 23.89),
    "楚雄彝族自治州": (101.55, 25.04), "红河哈尼族彝族自治州": (103.38, 23.37),
    "文山壮族苗族自治州": (104.24, 23.37), "西双版纳傣族自治州": (100.80, 22.01),
    "大理白族自治州": (100.23, 25.59), "德宏傣族景颇族自治州": (98.58, 24.44),
    "怒江傈僳族自治州": (98.85, 25.85), "迪庆藏族自治州": (99.71, 27.83),
    "上海市": (121.47, 31.23), "北京市": (116.40, 39.90),
    "天津市": (117.20, 39.13), "重庆市": (106.55, 29.56),
}

# What a full province name may end in, longest first.
PROVINCE_SUFFIXES = ["维吾尔自治区", "特别行政区", "壮族自治区", "回族自治区", "自治区", "省", "市"]
# Column of a wide matrix for categories outside the fixed labels.
OTHER_CATEGORIES = "其他"
