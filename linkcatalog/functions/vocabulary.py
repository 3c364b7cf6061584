"""Word lists, names and patterns that results depend on."""

# Words for picture, sound and edition that are no part of a title.
QUALITY_WORDS = (
    "2160p", "1080p", "1080i", "720p", "576p", "480p", "4k", "8k", "uhd", "fhd", "hd", "hdr10+", "hdr10", "hdr", "sdr",
    "dolbyvision", "dovi", "dv", "remux", "60fps", "30fps", "24fps", "fps", "ddp5", "ddp51", "ddp", "nf", "netflix",
    "itunes", "amzn", "disney", "hmax", "bluray", "blu-ray", "bdrip", "bdremux", "web-dl", "webdl", "webrip", "web",
    "hdtv", "dvdrip", "hdrip", "tvrip", "h264", "h265", "x264", "x265", "hevc", "avc", "av1", "10bit", "8bit", "aac",
    "ac3", "dts-hd", "dts", "truehd", "atmos", "flac", "ddp5.1", "dd5.1", "国语", "粤语", "英语", "日语", "韩语", "双语",
    "多语", "原声", "蓝光", "原盘", "高清", "超清", "标清", "高码", "高码率", "杜比视界", "杜比全景声", "4khdr", "4khdr10",
    "1080phdr", "2160", "1080", "720", "480",
)
GLUED_WORDS = (
    "杜比音效", "比音效", "杜比环绕声", "杜比全景声", "杜比视界", "立体声", "帧绮映画", "绮映画", "hdr真彩", "真彩", "超分",
    "无水印", "新番首播", "定档pv", "链接不失效", "每周自动更新", "自动更新", "持续更新", "3d动画", "动漫版", "动画版",
    "蓝光原盘", "原盘", "全4k", "全1080p", "多国字幕", "多国语言", "多国配音", "国英双音", "双语音轨", "双音轨", "音轨", "双音",
)
REGION_NOISE = (
    "国产", "大陆", "内地", "香港", "台湾", "日本", "韩国", "美国", "英国", "泰国", "印度", "欧美", "日韩", "国漫", "日漫", "美漫",
)
SUBTITLE_WORDS = (
    "中字", "中文字幕", "英文字幕", "双语字幕", "官方字幕", "简体中文", "繁体中文", "中英字幕", "简繁", "简体", "繁体", "内嵌",
    "内封", "外挂", "官方中字", "无字幕", "生肉", "熟肉", "双字", "嵌入", "字幕",
)
STATUS_WORDS = (
    "完结", "已完结", "未删减", "删减版", "修复版", "重制版", "加长版", "导演剪辑版", "剧场版本", "抢先版", "枪版", "试看版", "首播", "全集",
)
TITLE_LABELS = (
    "名称", "片名", "剧名", "标题", "资源名称", "资源名", "资源标题", "资源的名称", "影片名称", "影片名", "电影名", "剧集名",
    "番名", "title", "name",
)
CATEGORY_WORDS = (
    "电视剧", "电影", "动漫", "动画", "国漫", "日漫", "美漫", "番剧", "短剧", "微短剧", "剧集", "连续剧", "网剧", "国剧", "美剧",
    "韩剧", "日剧", "港剧", "台剧", "泰剧", "英剧", "综艺", "纪录片", "影片", "剧场版",
)
GENRE_NOISE = (
    "动作", "奇幻", "玄幻", "仙侠", "武侠", "喜剧", "爱情", "科幻", "悬疑", "恐怖", "惊悚", "战争", "犯罪", "冒险", "古装", "都市",
    "校园", "热血", "治愈", "后宫", "搞笑", "励志", "家庭", "青春", "历史", "军事", "传记", "歌舞", "剧情",
)
PROMO_WORDS = ("免费", "免费观看", "在线观看", "免费看", "会员", "秒播", "直链", "资源分享", "资源合集", "合集", "打包", "全集")
GROUP_WORDS = (
    "hiveweb", "hive", "frds", "cmct", "beast", "wiki", "hdchina", "hdsky", "ourbits", "ttg", "mteam", "chd", "ourtv", "nukehd", "sublime",
)
STRAY_WORDS = ("text", "txt", "全", "硬", "版", "补", "超", "完", "集", "年", "声", "特效")
DUMP_FIELDS = (
    "译名", "片名", "原名", "又名", "年代", "产地", "国家", "地区", "类别", "类型", "语言", "字幕", "上映日期", "豆瓣评分",
    "豆瓣链接", "imdb评分", "imdb链接", "文件格式", "视频尺寸", "文件大小", "片长", "导演", "主演", "编剧", "简介", "标签",
)
DUMP_TITLE_FIELDS = ("译名", "片名", "原名")
CUT_LABELS = (
    "导演", "编剧", "主演", "配音", "监制", "出品", "类型", "制片国家", "制片地区", "语言", "上映日期", "首播日期", "首播", "集数",
    "单集片长", "片长", "又名", "原名", "豆瓣评分", "imdb", "剧情简介", "内容简介", "剧情介绍", "作者", "译者", "主播", "演播",
    "播音", "出版社", "字数", "连载状态",
)
FREE_LABELS = ("资源名称", "资源的名称", "资源标题", "影片名称", "剧情简介", "内容简介", "豆瓣评分", "文件大小", "提取码", "访问码", "分享码")
COLON_LABELS = ("简介", "描述", "标签", "评分", "大小", "格式", "时长", "地区", "主演", "导演", "编剧", "上映", "片长")
#: A single letter that belongs to the word after it.
LETTER_TITLES = (
    ("C", "语言"), ("C", "程序"), ("C", "罗"), ("X", "战警"), ("A", "计划"), ("B", "计划"), ("K", "歌"), ("O", "记"), ("W", "两个世界"),
)

# Whole titles that are page text, field names or categories.
JUNK_TITLES = (
    "夸克", "夸克网盘", "夸克度盘", "百度", "百度盘", "百度网盘", "度盘", "阿里", "阿里云盘", "阿里网盘", "迅雷", "迅雷网盘", "天翼",
    "天翼云盘", "uc", "uc网盘", "115", "115网盘", "移动云盘", "光鸭云盘", "网盘", "云盘", "链接", "原链接", "下载链接", "分享链接",
    "社区链接", "网盘链接", "磁力", "磁力链接", "磁力下载", "下载", "在线播放", "立即播放", "查看资源", "查看详情", "点击查看", "点击",
    "浏览", "浏览器", "更多", "展开", "转存", "失效补档", "补档", "求片", "投稿", "感谢", "资源", "资源名", "资源名称", "标题", "名称",
    "描述", "简介", "标签", "备注", "序号", "详情", "大小", "文件大小", "提取码", "访问码", "分享码", "豆瓣评分", "评分", "格式", "时长",
    "地区", "年份", "年代", "类型", "画质", "集数", "更新",
)
CATEGORY_TITLES = (
    "短剧", "最新短剧", "热播短剧", "电影", "剧集", "电视剧", "连续剧", "新剧", "动漫", "动画", "动画片", "番剧", "国漫", "日漫", "美剧",
    "韩剧", "日剧", "泰剧", "港剧", "台剧", "英剧", "综艺", "真人秀", "纪录片", "少儿", "儿童", "影视", "热播", "完结", "追更",
)

# Tag words by dimension.
REGION_TAGS = ("国产", "内地", "大陆", "香港", "台湾", "美国", "日本", "韩国", "英国", "法国", "泰国", "印度", "欧美", "日韩", "港台")
LANGUAGE_TAGS = ("国语", "粤语", "英语", "日语", "韩语", "闽南语", "方言")
STOP_TAGS = ("转存", "收藏", "分享", "更新", "资源", "网盘", "夸克", "阿里", "百度", "求片", "投稿", "频道", "群组", "广告")
GENRE_TAGS = (
    "剧情", "喜剧", "爱情", "动作", "悬疑", "惊悚", "恐怖", "犯罪", "推理", "科幻", "奇幻", "玄幻", "武侠", "仙侠", "古装", "历史",
    "战争", "军事", "青春", "校园", "家庭", "伦理", "职场", "都市", "农村", "年代", "谍战", "冒险", "灾难", "传记", "音乐", "歌舞",
    "励志", "治愈", "热血", "搞笑", "甜宠", "虐恋", "宫斗", "宅斗", "重生", "穿越", "系统", "无限流", "西幻", "末世", "赛博朋克", "公路",
    "文艺", "商战", "医疗", "刑侦", "反转", "群像", "单元剧", "催泪", "爽剧",
)

# Words by which a media type is told, in the order in which they count.
MEDIA_TYPE_WORDS = (
    ("variety", ("综艺", "真人秀", "脱口秀", "访谈")),
    ("documentary", ("纪录片", "纪实", "documentary")),
    ("anime", ("动漫", "动画", "番剧", "国漫", "日漫", "anime")),
    ("tv", ("电视剧", "剧集", "连续剧", "网剧", "国剧", "短剧", "微短剧", "美剧", "韩剧", "日剧", "港剧", "台剧", "泰剧", "英剧")),
    ("movie", ("电影", "影片", "movie", "剧场版")),
)

# Hosts whose pages are no shared files.
BLOCKED_HOSTS = (
    "0kv.cn", "bangumi.bilibili.com", "book.douban.com", "discord.gg", "douc.cc", "douban.com", "dwz.cn", "dwz.tax", "f.srl",
    "film.qq.com", "film.sohu.com", "imdb.com", "j.srl", "jq.qq.com", "link3.cc", "m.srl", "manga.bilibili.com",
    "movie.douban.com", "my.tv.sohu.com", "pd.qq.com", "q.srl", "qm.qq.com", "qun.qq.com", "re0.me", "shorturl.fm",
    "site.douban.com", "space.bilibili.com", "t.cn", "t.me", "telegra.ph", "telegram.me", "tv.sohu.com", "u3v.cn", "url.cn",
    "urlxf.qq.com", "v.qq.com", "v.youku.com", "www.acfun.cn", "www.acfun.tv", "www.bilibili.com", "www.douban.com",
    "www.imdb.com", "www.le.com", "www.letv.com", "www.link3.cc", "www.themoviedb.org", "www.youtube.com", "youtu.be",
)

# Link forms of each provider, in the order in which they count; the share id is group 1.
PROVIDER_FORMS = (
    ("quark", r"https?://pan\.quark\.cn/s/([A-Za-z0-9]+)"),
    ("uc", r"https?://drive\.uc\.cn/s/([A-Za-z0-9]+)"),
    ("alipan", r"https?://(?:www\.)?(?:alipan|aliyundrive)\.com/[st]/([A-Za-z0-9]+)"),
    ("baidu", r"https?://(?:pan|yun)\.baidu\.com/(?:s/1|share/init\?surl=)([A-Za-z0-9_-]+)"),
    ("pan115", r"https?://(?:115|115cdn|anxia)\.com/s/([A-Za-z0-9]+)"),
    ("pan123", r"https?://(?:(?:www\.)?123(?:pan|\d+)\.com|(?:[a-z0-9-]+\.)*123pan\.cn)/(?:s|123pan)/([A-Za-z0-9_-]+)"),
    ("mobile139", r"https?://yun\.139\.com/shareweb/#/w/i/([A-Za-z0-9_-]+)"),
    ("guangya", r"https?://(?:www\.)?guangyapan\.com/s/([A-Za-z0-9_-]+)"),
    (
        "ctfile",
        r"https?://(?:[a-z0-9-]+\.)?(?:ctfile\.(?:com|net)|pipipan\.com|400gb\.com|t00y\.com|72k\.us|colafile\.com"
        r"|n459\.com|sn9\.us|545c\.com|590m\.com)/((?:file|fs|dir|f|d)/[A-Za-z0-9_-]+)",
    ),
    ("tianyi", r"https?://cloud\.189\.cn/t/([A-Za-z0-9]+)"),
    ("xunlei", r"https?://pan\.xunlei\.com/s/([A-Za-z0-9_-]+)"),
    ("lanzou", r"https?://(?:[a-z0-9-]+\.)?lanzou[a-z]*\.com/([A-Za-z0-9_-]+)"),
    ("magnet", r"magnet:\?xt=urn:btih:([A-Za-z0-9]+)"),
    ("ed2k", r"ed2k://\|file\|.*?\|\d+\|([A-Fa-f0-9]{32})\|"),
)
CHECKABLE = ("quark", "alipan", "uc", "pan123", "ctfile")
