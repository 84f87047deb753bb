"""Row schemas and type vocabularies of chat exports."""

from pyspark.sql import types as T

CHAT_CSV = T.StructType([
    T.StructField(n, t) for n, t in (
        ("id", T.LongType()), ("MsgSvrID", T.StringType()), ("type_name", T.StringType()), ("is_sender", T.IntegerType()),
        ("talker", T.StringType()), ("room_name", T.StringType()), ("msg", T.StringType()), ("src", T.StringType()), ("CreateTime", T.StringType()),
    )
])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
PII_SPANS = "array<struct<entity_type:string,start:int,end:int,score:double,text:string>>"

# Message types that end a conversation, and types whose rows are deleted; both lists are index-aligned by language.
CUT = {
    "zh": ["cut", "Cut", "图片", "视频", "合并转发的聊天记录", "语音", "(分享)音乐", "(分享)卡片式链接", "(分享)笔记", "(分享)小程序", "(分享)收藏夹", "(分享)视频号名片", "(分享)视频号视频", "粘贴的文本", "未知"],
    "en": ["cut", "Cut", "image", "video", "merged forward chat records", "voice", "(share) music", "(share) card link", "(share) note", "(share) mini program", "(share) favorites", "(share) video account card", "(share) video account video", "pasted text", "unknown"],
}
SKIP = {
    "zh": ["添加好友", "推荐公众号", "动画表情", "用户上传的GIF表情", "位置", "文件", "位置共享", "引用回复", "群公告", "转账", "语音通话", "系统通知", "消息撤回", "拍一拍", "邀请加群"],
    "en": ["add friend", "recommend official account", "sticker", "sticker2", "location", "file", "location sharing", "reply with quote", "group announcement", "transfer", "voice call", "system notification", "message recall", "pat pat", "invite to group"],
}
TEXT_TYPES, IMAGE_TYPES = ("文本", "text"), ("图片", "image")
IMAGE_MARK, BEGIN = "<image>", "<begin_chat>"
NO_BREAK_AFTER = "。.！!？?…，,"
