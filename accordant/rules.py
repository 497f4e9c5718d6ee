"""Rule sets. Everything here is data; every operator takes its rules as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field

# Canonical fields and the header aliases tried for each, in priority order.
FIELD_ALIASES: dict[str, tuple[str, ...]] = {
    "company": ("公司名称", "公司", "企业名称", "企业", "company", "employer"),
    "title": ("招聘岗位", "岗位名称", "职位名称", "岗位", "职位", "title", "role"),
    "cities": ("工作城市", "工作地点", "城市", "地点", "city", "location"),
    "graduation_years": ("毕业年份", "毕业届次", "届次", "graduation_year", "graduate_year"),
    "education": ("学历要求", "学历", "education", "degree"),
    "recruitment_type": ("招聘批次", "招聘类型", "批次", "类型", "batch", "recruitment_type"),
    "industry": ("行业类别", "行业", "industry"),
    "employer_type": ("企业类型", "公司性质", "企业性质", "employer_type"),
    "written_test": ("笔试要求", "是否笔试", "免笔试", "written_test", "assessment"),
    "published_at": ("发布日期", "发布时间", "发布日", "published_at", "publish_date"),
    "deadline": ("截止日期", "截止时间", "申请截止", "deadline"),
    "announcement_url": ("公告链接", "来源链接", "详情链接", "announcement_url", "source_url"),
    "apply_url": ("投递方式", "投递链接", "申请链接", "apply_url", "application_url"),
    "official_job_id": ("岗位ID", "职位ID", "job_id", "position_id"),
    "source_record_id": ("记录ID", "record_id", "source_record_id"),
    "notes": ("备注", "说明", "notes"),
}
POSITIONAL_HEADERS = ("序号", "行号", "编号", "index", "row_number")
LIST_FIELDS = ("cities", "graduation_years", "education")
URL_FIELDS = ("announcement_url", "apply_url")
COPYRIGHT_MARKERS = ("正版授权", "转售必究")

# Text normalisation.
COMPANY_SUFFIXES = ("股份有限公司", "有限责任公司", "科技有限公司", "有限公司", "集团股份", "集团")
VALUE_SEPARATORS = "[、，,；;/|]+"
DROP_QUERY_KEYS = ("source", "from", "share", "shareid", "track", "channel")
DROP_QUERY_PREFIX = "utm_"


@dataclass(frozen=True)
class IdRules:
    """How a posting id is recognised in text, paths and query strings."""

    # Fixed values.
    text_pattern: str = r"(?iU)职位\s*ID\s*[:：]?\s*([A-Za-z0-9_-]{3,})"
    generic_tokens: tuple[str, ...] = (
        "career", "careers", "campus", "detail", "graduate", "graduates", "home", "index",
        "job", "jobs", "list", "opening", "openings", "position", "positions", "program",
        "recruitment", "search", "student", "students",
    )
    generic_fragments: tuple[str, ...] = (
        "campus", "earlycareer", "early-career", "graduate", "program", "recruit", "student",
    )
    containers: tuple[str, ...] = (
        "position", "positions", "job", "jobs", "openings", "jobdetail", "job-detail",
    )
    unsafe_segments: tuple[str, ...] = (
        "about", "article", "campus", "graduate", "news", "program", "recruitment",
    )
    query_keys: tuple[str, ...] = (
        "job_id", "jobid", "position_id", "positionid", "posting_id", "postingid",
    )
    context_query_keys: tuple[str, ...] = ("id",)
    min_length: int = 4
    broad_url_markers: tuple[str, ...] = (
        "campus", "graduate", "program", "recruitment", "student", "early-career", "early_career",
    )
    generic_terminals: tuple[str, ...] = (
        "career", "careers", "campus", "campus-recruitment", "detail", "graduate", "graduates",
        "home", "index", "list", "position", "positions", "search", "students", "early-careers",
    )


@dataclass(frozen=True)
class KindRules:
    """Markers that separate a campaign row from a single posting."""

    # Fixed values.
    broad_markers: tuple[str, ...] = (
        "岗位详见", "岗位请见", "招聘岗位", "技术类", "产品类", "研发类", "运营类", "职能类",
        "设计类", "市场类", "多个岗位", "岗位族", "校招启动", "校园招聘",
    )
    role_suffixes: tuple[str, ...] = (
        "工程师", "产品经理", "实习生", "分析师", "研究员", "设计师", "顾问", "专员", "管培生",
    )
    counted_suffixes: str = "工程师|产品经理|实习生|分析师|研究员|设计师|顾问|专员"
    family_pattern: str = "方向|岗位|(?<!位)岗|类"
    role_signals: str = (
        "工程师|产品经理|产品运营|解决方案|项目交付|实习生|分析师|研究员|"
        "设计师|顾问|专员|管培生|研发|算法|测试|职能"
    )
    category_signals: str = (
        "市场营销|软件开发|机电维护|供应链|解决方案|"
        "产品|研发|销售|运营|市场|物流|职能|设计|技术|算法|数据|"
        "工程|金融|财务|审计|寄递|内容|商务"
    )
    unit_suffix: str = "中心"
    separators: str = VALUE_SEPARATORS


@dataclass(frozen=True)
class TitleRules:
    """Ordered label rules for campaign titles. First hit wins."""

    # Fixed values.
    roles: tuple[tuple[str, str], ...] = (
        ("AI 产品经理", "(?iu)(?:AI|大模型|Agent|智能)[^，、；;]{0,12}产品"),
        ("数据产品经理", "数据[^，、；;]{0,10}(?:产品|分析|平台|系统)"),
        ("技术产品经理", "(?:技术|平台|软件|研发)[^，、；;]{0,10}产品"),
        ("产品经理", "产品(?:经理|岗|类|方向|实习)"),
        ("解决方案工程师", "(?:解决方案|售前|方案工程师)"),
        ("数据分析师", "数据分析(?:师|岗|方向)?"),
        ("项目经理", "项目管理|项目经理"),
        ("客户服务经理", "客户服务经理"),
        ("软件开发工程师", "软件(?:开发|研发)(?:工程师|岗)?"),
        ("产品运营", "产品运营"),
        ("内容产品经理", "内容[^，、；;]{0,8}(?:产品|运营)"),
    )
    industries: tuple[tuple[str, str], ...] = (
        ("机器人产品经理", "机器人|自动驾驶|无人|智能驾驶"),
        ("能源数字化产品经理", "能源|电力|风电|光伏|储能|新能源"),
        ("半导体技术产品经理", "半导体|芯片|集成电路|设备|电子"),
        ("AI 产品经理", "人工智能|大模型|Agent|互联网|软件"),
        ("平台产品经理", "通信|云计算|基础设施"),
        ("金融产品经理", "金融|银行|证券|保险|财税|审计"),
        ("教育产品经理", "教育|培训"),
        ("内容产品经理", "传媒|媒体|内容|文娱|游戏"),
        ("工业数字化产品经理", "制造|机械|汽车|工业|化工"),
    )
    default: str = "产品经理"
    family_pattern: str = "类岗位|岗位类|方向|详见官网|岗位详见"
    separator_pattern: str = "[，、；;/]"
    repeated: tuple[str, ...] = ("类", "岗位")
    trim_chars: str = " ;；，、"
    min_families: int = 2
    min_repeats: int = 3
    min_separators: int = 3
    long_title: int = 48


@dataclass(frozen=True)
class ScopeRules:
    """Hosts that may not, or may only with a tenant path, anchor an organization."""

    # Fixed values.
    aggregators: tuple[str, ...] = (
        "offercoming.cn", "offerbiu.com", "nowcoder.com", "shixiseng.com", "zhipin.com",
        "51job.com", "zhaopin.com", "jobui.com", "liepin.com", "mp.weixin.qq.com",
        "weixin.qq.com", "docs.qq.com", "feishu.cn", "notion.site", "github.io", "vercel.app",
        "netlify.app", "pages.dev", "web.app",
    )
    shared_hosts: tuple[str, ...] = (
        "apply.workable.com", "boards.greenhouse.io", "job-boards.greenhouse.io",
        "jobs.ashbyhq.com", "jobs.lever.co", "jobs.smartrecruiters.com",
    )
    shared_parents: tuple[str, ...] = (
        "ashbyhq.com", "greenhouse.io", "lever.co", "myworkdayjobs.com", "myworkdaysite.com",
        "smartrecruiters.com", "workable.com",
    )
    infrastructure_pattern: str = r"^wd[0-9]+\.(?:myworkdayjobs|myworkdaysite)\.com$"
    # Without a suffix table these are all the suffixes there are; pass a table for real hosts.
    public_suffixes: tuple[str, ...] = (
        "com", "net", "org", "cn", "com.cn", "net.cn", "org.cn", "io", "co", "app", "dev",
        "site", "example",
    )


@dataclass(frozen=True)
class FactRules:
    """Line patterns that turn profile text into facts."""

    # Fixed values.
    bullet_chars: str = " \t#-*•"
    graduation: tuple[str, ...] = (
        r"(?U)((?:19|20)\d{2})\s*届",
        r"(?U)(?:预计\s*)?((?:19|20)\d{2})\s*年\s*(?:预计\s*)?毕业",
        r"(?U)(?:预计\s*)?((?:19|20)\d{2})\s*(?:[./-]|年)\s*\d{1,2}\s*月?\s*毕业",
        r"(?U)毕业时间\s*[:：]?\s*((?:19|20)\d{2})",
    )
    graduation_suffix: str = "届"
    education: tuple[tuple[str, str], ...] = (
        ("博士", r"(?iu)博士|Ph\.?D"),
        ("硕士", "(?iu)硕士|研究生|Master"),
        ("本科", "(?iu)本科|学士|Bachelor"),
        ("大专", "大专|专科"),
    )
    skills: tuple[tuple[str, str], ...] = (
        ("Python", "(?iu)(?<![A-Za-z0-9])Python(?![A-Za-z0-9])"),
        ("SQL", "(?iu)(?<![A-Za-z0-9])SQL(?![A-Za-z0-9])"),
        ("AI", "(?iu)(?<![A-Za-z0-9])AI(?![A-Za-z0-9])|人工智能|大模型|机器学习"),
        ("产品", r"(?iU)产品经理|需求分析|用户调研|\bPRD\b|原型"),
        ("数据", "数据分析|数据处理|指标体系|数据平台"),
        ("平台", "平台|中台|开发者服务"),
        ("解决方案", "解决方案|技术咨询|行业方案"),
        ("仿真", r"(?iU)仿真|数字孪生|\bSIL\b|\bHIL\b"),
        ("测试评测", "测试|评测|评估|质量"),
    )
    project: str = "项目|平台|系统|原型|产品"
    experience: str = "负责|参与|设计|梳理|分析|搭建|实现|调研|推进|迭代|评测|验证"
    min_story_length: int = 14
    label_min: int = 2
    label_max: int = 28
    project_fallback: str = "项目证据"
    experience_fallback: str = "经历证据"
    correction_prefix: str = "用户修正："


@dataclass(frozen=True)
class DecisionRules:
    """Dictionary, ranks and thresholds of the three decision axes."""

    # Fixed values.
    dictionary: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "AI": ("AI", "人工智能", "大模型", "LLM", "RAG", "Agent", "机器学习"),
            "产品": ("产品", "需求分析", "用户调研", "PRD", "原型", "竞品"),
            "数据": ("数据", "SQL", "Python", "指标", "分析"),
            "平台": ("平台", "中台", "开发者服务"),
            "解决方案": ("解决方案", "咨询", "交付", "实施"),
            "仿真": ("仿真", "数字孪生", "SIL", "HIL"),
            "测试评测": ("测试", "评测", "评估", "质量"),
        }
    )
    education_rank: tuple[tuple[str, int], ...] = (
        ("大专", 1), ("本科", 2), ("硕士", 3), ("博士", 4),
    )
    anywhere: str = "全国"
    year_pattern: str = r"(?U)(?:19|20)\d{2}"
    # Ordered folding of recruitment types: any marker -> label.
    type_folding: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("补录", ("补录",)),
        ("实习", ("实习",)),
        ("校招", ("秋招", "春招", "校招", "应届", "提前批")),
    )
    fit_kinds: tuple[str, ...] = ("SKILL", "EXPERIENCE", "PROJECT")
    primary_matches: int = 3
    primary_coverage: float = 0.6
    primary_spans: int = 2
    apply_matches: int = 2
    apply_coverage: float = 0.5
    max_age_days: float = 14.0
    generic_values: tuple[str, ...] = (
        "AI", "Python", "SQL", "产品", "平台", "数据", "测试评测", "解决方案",
    )


@dataclass(frozen=True)
class PairRules:
    """Weights and cut-offs of duplicate scoring."""

    # Fixed values.
    title: float = 0.55
    city: float = 0.2
    year: float = 0.15
    batch: float = 0.1
    keep_score: float = 0.78
    hint_score: float = 0.99
    conflict_title: float = 0.92
    conflict_city: float = 0.5


@dataclass(frozen=True)
class AuditRules:
    """Supplier audit markers."""

    # Fixed values.
    separators: str = "[、,，;；/|]"
    generic_markers: tuple[str, ...] = ("产品类", "研发类", "运营类", "技术类", "职能类", "岗位详见")
    date_pattern: str = r"^20[0-9]{2}-[0-9]{2}-[0-9]{2}$"
    url_pattern: str = "<(https?://[^>]+)>"
    target_year: str = "2027届"
    target_city: str = "上海"
    target_keywords: tuple[str, ...] = ("产品", "数据", "解决方案", "AI", "人工智能", "平台")


# Ordered authority levels.
AUTHORITY_AGGREGATOR = 10
AUTHORITY_OFFICIAL_CAMPAIGN = 20
AUTHORITY_OFFICIAL_POSTING = 30
AUTHORITY_USER = 40

# Fields a reviewer may record with an official check, and their limits.
REVIEWABLE_FIELDS = ("cities", "graduation_years", "education", "recruitment_type", "deadline")
REVIEW_LIST_ITEMS = 30
REVIEW_ITEM_CHARS = 100
REVIEW_TEXT_CHARS = 300
MIN_EXCERPT_CHARS = 5
CLOCK_TOLERANCE_MINUTES = 5

# Columns of the exported shortlist and the application stages.
EXPORT_COLUMNS = (
    "company", "title", "cities", "eligibility", "evidence_fit", "trust", "verification",
    "apply_url", "application_stage", "next_action", "next_action_at", "priority", "note",
)
STAGES = ("TO_APPLY", "APPLIED", "ASSESSMENT", "INTERVIEW", "OFFER", "REJECTED", "WITHDRAWN")
