"""Fixed values that decide results: word lists, weights, extension lists.

They are data, not logic.  Longer dimensions (stage words, query synonyms,
tag rules, tag vocabularies) are passed to the operators as tables.
"""

# File extensions by kind.
VIDEO_EXTS = [".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v", ".flv", ".ts"]
RAW_EXTS = [".raw", ".cr2", ".cr3", ".nef", ".arw", ".dng", ".orf", ".rw2", ".pef", ".srw", ".x3f"]
SUBTITLE_EXTS = [".srt", ".ass", ".ssa", ".vtt", ".sub", ".sbv"]
IMAGE_EXTS = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".svg", ".tif", ".tiff", ".ico", ".heic", ".gif"]
AUDIO_EXTS = [".mp3", ".wav", ".ogg", ".flac", ".m4a", ".aac"]
VECTOR_EXTS = [".ai", ".eps", ".cdr", ".emf", ".wmf"]
MODEL3D_EXTS = [".glb", ".gltf", ".obj", ".fbx", ".blend", ".dae", ".3ds", ".stl", ".ply"]
PROJECT_EXTS = [".aep", ".prproj", ".psd", ".psb", ".mogrt", ".fcpxml", ".drp", ".sesx"]
FONT_EXTS = [".ttf", ".otf", ".woff", ".woff2", ".eot"]
DOCUMENT_TYPES = {
    "type:subs": SUBTITLE_EXTS,
    "type:pdf": [".pdf"],
    "type:doc": [".doc", ".docx", ".rtf", ".epub"],
    "type:text": [".txt", ".md"],
    "type:sheet": [".xls", ".xlsx", ".csv"],
    "type:slide": [".ppt", ".pptx"],
    "type:data": [".json", ".yaml", ".yml", ".html"],
}

# Tags that merges never remove, and tags hidden from the tag cloud.
PROTECTED_TAGS = ["sp", "demux", "asr", "bilibili", "youtube", "upload"]
PROTECTED_PREFIXES = ["role:", "has_audio:", "parent:", "from:", "t_start:", "t_end:", "job:", "type:", "lang:"]
HIDDEN_TAGS = ["has_audio:0", "has_audio:1", "role:picture"]
HIDDEN_PREFIXES = ["from:", "t_start:", "t_end:"]
INHERITED_TAGS = ["sp", "bilibili", "youtube", "upload"]

# Display labels of tags, (Chinese, English).
EXACT_TAG_LABELS = {
    "sp": ("来源·流水线", "src·pipeline"),
    "upload": ("来源·上传", "src·upload"),
    "bilibili": ("平台·B站", "platform·Bilibili"),
    "youtube": ("平台·YouTube", "platform·YouTube"),
    "demux": ("拆条产物", "demuxed"),
    "asr": ("ASR 音轨", "ASR audio"),
}
TYPE_TAG_LABELS = {
    "media": ("源片", "source media"),
    "clip": ("物理切片", "export clip"),
    "subs": ("字幕", "captions"),
    "notes": ("笔记", "notes"),
    "benchmark": ("基准样例", "benchmark"),
    "render": ("渲染预览", "render"),
    "test": ("测试样例", "test"),
    "batch": ("任务杂项", "job misc"),
    "other": ("其它", "other"),
}
ROLE_TAG_LABELS = {
    "master": ("母版", "master"),
    "clip": ("物理切片", "export clip"),
    "silent-picture": ("无声画面", "silent picture"),
    "audio-stem": ("音轨组件", "audio stem"),
    "picture": ("画面轨", "picture track"),
}

# Model tags that carry no information.
MODEL_TAG_STOP = [
    "video", "videos", "media", "multimedia", "footage", "clip", "clips", "scene", "scenes", "content", "raw", "person", "people",
    "character", "characters", "render", "renders", "material", "materials", "asset", "assets", "sample", "samples", "file", "files",
    "image", "images", "photo", "photos", "picture", "pictures", "audio", "movie", "movies", "test", "testing", "demo", "example",
    "unknown", "none", "null", "untitled", "new", "old", "素材", "视频", "媒体", "片段", "场景", "内容", "人物", "画面", "渲染", "测试", "笔记", "说明", "预览",
    "其他", "无", "空", "默认", "通用", "杂", "资料", "文件", "图片", "照片", "type", "fix", "fixed", "fast", "verify", "verified", "review", "check",
    "result", "output", "processed", "final", "clean", "cleaned", "enhanced", "upscaled", "restored", "model", "ai", "tool", "auto",
    "batch", "good", "bad", "best", "high", "low", "quality",
]
MODEL_TAG_MAX = 6
MODEL_TAG_MAX_LEN = 20

# Words that never form an open entity.
ENTITY_STOP = [
    "a", "an", "the", "of", "in", "on", "at", "to", "with", "and", "or", "is", "are", "was", "were", "be", "been", "being", "this",
    "that", "these", "those", "it", "its", "as", "by", "for", "from", "into", "out", "over", "under", "up", "down", "above", "below",
    "near", "there", "here", "then", "than", "show", "shows", "showing", "shown", "depict", "depicts", "depicting", "feature",
    "features", "featuring", "appear", "appears", "scene", "view", "shot", "frame", "camera", "photo", "photos", "image", "images",
    "picture", "pictures", "video", "footage", "person", "people", "man", "woman", "close", "closeup", "close-up", "outdoors",
    "indoors", "background", "foreground", "left", "right", "top", "bottom", "front", "back", "side", "while", "during", "before",
    "after", "around", "between", "thing", "things", "object", "objects", "stuff", "item", "items", "something", "anything", "nothing",
    "content", "subject", "matter", "type", "kind", "sort", "example", "sample", "color", "colors",
]

# Tags once written by rule tagging; a rollback keeps "bilibili".
RULE_WRITTEN_TAGS = [
    "dehardsub", "deblur", "segment", "subs", "cmp", "facefix", "benchmark", "combine", "watermark", "out", "test", "media", "render",
    "probe", "notes",
]

# Retrieval weights.
FIELD_WEIGHTS = {"name": 3.0, "tags": 2.5, "description": 1.5, "rel_path": 1.0}
CHANNEL_WEIGHT = 0.35
LOOSE_FACTOR = 0.6
LOOSE_MIN_LEN = 5
RRF_K = 60
RRF_LEXICAL_WEIGHT = 20.0
RRF_MISSING_RANK = 1_000_000
MIN_DENSE_COS = 0.25
RERANK_TOP = 60

# Fields kept in a version payload.
VERSION_FIELDS = [
    "name", "orig_name", "tags", "ai_tags", "description", "form", "topics", "usage", "source", "kind", "ext", "rel_path",
]

# Language codes with a display name.
LANGUAGE_NAMES_ZH = {
    "zh": "中文", "zh-hans": "简体中文", "zh-hant": "繁体中文", "zh-hk": "繁体中文", "en": "英文", "ja": "日文",
    "ko": "韩文", "ru": "俄文", "fr": "法文", "de": "德文", "es": "西班牙文", "pt": "葡萄牙文", "ar": "阿拉伯文",
    "hi": "印地文", "id": "印尼文", "th": "泰文", "tr": "土耳其文", "vi": "越南文",
}

# Names of unfinished files.
PLACEHOLDER_NAME = r"(?i)(temp|tmp|草稿|占位|placeholder|draft|未命名|untitled|新建|copy|副本|\.bak|test_|_test)"

# Query synonyms shown only when nothing more specific matched.
WEAK_SYNONYMS = ["视频", "图片", "状态"]
QUERY_ABBREVIATIONS = {
    "4k": ["upscale", "esrgan"],
    "8k": ["upscale", "esrgan"],
    "超清": ["upscale", "esrgan"],
    "超分辨率": ["upscale", "esrgan", "super resolution"],
    "语音识别": ["asr", "transcribe", "subs"],
    "文字识别": ["ocr"],
    "gpu": ["gpu"],
    "界面": ["ui", "interface"],
    "帧率": ["fps", "frames", "frame"],
}

# Form taxonomy as (parent, child) edges; top-level groups have parent "".
FORM_EDGES = [
    ("", "live"), ("live", "live_talk"), ("live_talk", "live_talk_solo"), ("live_talk", "live_talk_dialogue"),
    ("live_talk", "live_vo"), ("live", "live_vlog"), ("live_vlog", "live_vlog_vlog"), ("live_vlog", "live_daily"),
    ("live", "live_interview"), ("live", "live_story"), ("live_story", "live_story_clip"), ("live_story", "live_sitcom"),
    ("live", "live_broll"), ("live_broll", "live_broll_nature"), ("live_broll", "live_broll_city"),
    ("live_broll", "live_broll_industry"), ("live_broll", "live_broll_weather"), ("live", "live_fx"), ("live", "live_ai"),
    ("", "anim2d"), ("anim2d", "flat2d"), ("anim2d", "mg2d"), ("mg2d", "mg2d_title"), ("mg2d", "mg2d_data"),
    ("anim2d", "hand2d"), ("anim2d", "comic2d"), ("", "anim3d"), ("anim3d", "cgi3d"), ("anim3d", "toon3d"),
    ("anim3d", "product3d"), ("product3d", "product3d_show"), ("product3d", "product3d_arch"), ("anim3d", "vfx3d"),
    ("", "anime"), ("anime", "anime_jp"), ("anime", "anime_cn"), ("anime", "anime_3d"), ("anime", "anime_manga"),
    ("", "ai"), ("ai", "ai_txt2vid"), ("ai", "ai_img"), ("ai", "ai_digital"), ("ai", "ai_scene"), ("ai", "ai_anime"),
    ("", "stop"), ("stop", "stop_clay"), ("stop", "stop_obj"), ("", "other"),
]
TOPIC_GROUPS = {
    "生活方式": ["美食", "萌宠", "母婴", "情感"],
    "时尚美妆": ["美妆", "穿搭"],
    "知识教育": ["知识", "教育", "财经", "科技"],
    "影视娱乐": ["影视", "搞笑", "音乐", "舞蹈"],
    "游戏二次元": ["游戏", "二次元"],
    "出行运动": ["旅行", "汽车", "运动"],
    "剧情故事": ["剧情"],
}
USAGES = ["短视频", "短剧", "影视", "公司宣传", "广告", "课程", "直播", "纪录片"]
