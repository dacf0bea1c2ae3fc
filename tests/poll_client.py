"""A client of the session source: three sessions, newest first; one fails."""


def client(session_id, offset, size):
    if session_id == "bad":
        raise OSError("down")
    rows = [{"msg_id": f"{session_id}-{i}", "sender_id": "u", "content": f"text {i}", "timestamp": i} for i in range(25, 0, -1)]
    return {"items": rows[offset : offset + size]}
