"""Analytics over logs of coding-agent sessions, as DataFrame operators."""
