r"""Emoji code-point ranges and the weight table."""

RANGES = ((0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF), (0x2702, 0x27B0),
          (0x24C2, 0x1F251), (0x1F900, 0x1F9FF), (0x1FA70, 0x1FAFF), (0x2600, 0x26FF), (0x2700, 0x27BF),
          (0xFE00, 0xFE0F), (0x1F000, 0x1F02F), (0x1F0A0, 0x1F0FF))
#: Ranges the remover covers (no selectors, tiles or cards).
REMOVER_RANGES = RANGES[:10]


def char_class(ranges=RANGES) -> str:
    return "[" + "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in ranges) + "]"


# emoji weight category score
TABLE = """
🚀 1.0 enthusiasm 0.95
🔥 1.0 enthusiasm 0.95
✨ 0.95 enthusiasm 0.92
⚡ 0.95 enthusiasm 0.90
💫 0.90 enthusiasm 0.88
🌟 0.90 enthusiasm 0.88
✅ 0.95 task_marker 0.92
❌ 0.95 task_marker 0.92
✔️ 0.90 task_marker 0.88
❎ 0.90 task_marker 0.88
☑️ 0.85 task_marker 0.85
⚠️ 0.60 warning 0.70
❗ 0.70 warning 0.75
❓ 0.65 info 0.70
ℹ️ 0.60 info 0.68
🔄 0.90 operation 0.88
➕ 0.85 operation 0.85
➖ 0.85 operation 0.85
➡️ 0.80 operation 0.82
⬅️ 0.80 operation 0.82
💰 0.90 finance 0.90
💵 0.90 finance 0.88
💳 0.88 finance 0.88
💎 0.85 finance 0.85
📝 0.80 docs 0.82
📄 0.78 docs 0.80
📊 0.82 docs 0.82
📈 0.80 docs 0.80
📉 0.80 docs 0.80
🎯 0.90 achievement 0.90
🎉 0.92 achievement 0.92
🏆 0.88 achievement 0.88
🥇 0.85 achievement 0.85
🔒 0.75 security 0.78
🔓 0.75 security 0.78
🔐 0.78 security 0.80
🔑 0.75 security 0.78
🐛 0.70 bug 0.72
🪲 0.70 bug 0.72
🐞 0.68 bug 0.70
💻 0.75 tech 0.78
🖥️ 0.72 tech 0.75
📱 0.70 tech 0.72
⚙️ 0.72 tech 0.75
🔧 0.70 tech 0.72
🛠️ 0.70 tech 0.72
"""
WEIGHTED = {
    char: (float(weight), category, float(score))
    for char, weight, category, score in (row.split() for row in TABLE.strip().splitlines())
}
HUMAN = "😊 😃 😄 👍 👎 🙂 🙏 ❤️ 💜 💙 😅 😂 🤣 😭 🤔 😎 🤷".split()
