"""Writers: text, markup and report forms of graphs and violations. Each makes a frame of lines or one document."""
