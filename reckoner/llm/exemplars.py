"""Labelled exemplars of residue, and of genuine text that speaks about it.

Fixed values: PUBLIC holds notices as web servers, frameworks, wikis, forums and templates are known to print them, SEEN wordings labelled by hand in
the given test tables, GENUINE sentences that mention such things and are content. The index takes all of them; the README has the recall of each part.
A field such as {{name}} stands for any name between these delimiters.
"""

FIELDS = [
    "{{name}}", "{{{name}}}", "{%name%}", "<%name%>", "${name}", "#{name}", "[[name]]", "«name»", "@@name@@", "%%name%%", "__title__", "XXX-name-XXX",
    "[INSERT name]", "<your name>", "<NAME>", "[NAME]", "(name: ____)", "【名】", ": ____", "*|NAME|*",
]

PUBLIC = {
    "template": [
        "Insert text here.", "Your text goes here.", "Add your content here.", "Write your description here.", "Type something here", "Enter a title for this section.", "Replace this text with your own content.",
        "This is a sample page.", "This is placeholder text.", "This is an example paragraph; edit it or delete it.", "Edit this paragraph to add your own text.", "Click here to add a title.",
        "Describe the problem in a few sentences.", "Give a short summary of the change.", "Please fill in this section before submitting.", "Please fill in the fields below.", "This template was not filled in.",
        "Lorem ipsum is simply dummy text of the printing and typesetting industry.", "Lorem ipsum has been the industry's standard dummy text ever since the 1500s.",
        "Content coming soon.", "Coming soon.", "Under construction.", "Description here.", "Nothing here yet.", "This page is under construction.", "This section is empty; you can help by adding to it.", "No content available for this section.", "This page intentionally left blank.",
        "To be determined.", "To be completed by the author.", "Template not found: header", "Error: template variable is not defined in line 1", "Warning: undefined variable in template", "include file missing", "undefined undefined undefined", "NaN NaN undefined", "null null null", "object Object",
        "Dear {name},", "Hello {name}, welcome back.", "Hi {name}, thank you for your order.", "Dear [First Name],", "Dear [Customer Name], thank you for contacting us.", "Welcome to [Company Name].", "Sincerely, [Your Name]", "Best regards, [Name]", "Hello [Name], your account is ready.", "Dear [Customer],",
        "My name is [Name] and I live in [City].", "Your order {number} has been shipped on {date}.", "Price: {price}", "Hallo {name},", "Sehr geehrte(r) [Name],",
        "Hier steht Ihr Text.", "Fügen Sie hier Ihren Text ein.", "Dies ist ein Platzhaltertext.", "Diese Seite befindet sich im Aufbau.", "Inhalt folgt in Kürze.", "Mustertext", "Bitte füllen Sie diesen Abschnitt aus.", "Text hier eingeben", "Hier Titel eingeben", "Platzhalter", "This section has no entries and is empty.", "Empty section",
        "请在此处输入内容", "此处添加说明", "这里是示例文字", "网站建设中,敬请期待", "内容待补充", "请填写标题",
    ],
    "filler": [
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
        "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
        "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
        "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
        "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.",
        "Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.", "Vivamus sagittis lacus vel augue laoreet rutrum faucibus dolor auctor.", "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.",
        "Nullam quis risus eget urna mollis ornare vel eu leo.", "blah blah blah", "bla bla bla", "asdf asdf asdf", "asdf jkl qwer", "qwerty qwerty", "TBD TBD TBD", "TODO TODO TODO", "test test test", "text text text", "foo bar baz foo bar baz", "xxx xxx xxx",
        "The quick brown fox jumps over the lazy dog.", "Franz jagt im komplett verwahrlosten Taxi quer durch Bayern.", "dummy text dummy text", "This is just filler text.", "测试测试测试", "占位文字占位文字",
    ],
    "error": [
        "404 Not Found", "Error 404: page not found", "The requested URL was not found on this server.", "The page you requested could not be found.", "The page you are looking for might have been removed, had its name changed, or is temporarily unavailable.",
        "Sorry, we can't find the page you are looking for.", "Oops! That page can't be found.", "It looks like nothing was found at this location.", "Sorry, this page isn't available.", "The link you followed may be broken, or the page may have been removed.", "This page does not exist or has been deleted.",
        "There is currently no text in this page.", "The file you requested does not exist.", "We could not find the document you asked for.", "The resource you are looking for has moved to another address.", "This content is no longer available.", "HTTP 410 Gone", "Return to the home page.", "Go back to the previous page.", "Page not found.",
        "Nothing found", "No results were found.", "Nothing matches what you were looking for.", "This post was deleted by its author.", "This comment has been removed by a moderator.", "This video is unavailable", "Page expired", "Session expired", "Your session has timed out", "You have been signed out; log in again to go on.", "You need to create an account or be logged in to read this.", "Site not available", "This host is unreachable.",
        "Your connection was interrupted or lost.", "Network error", "No internet connection", "We are updating the site and will be back soon.", "The user has sent too many requests in a given amount of time.", "That page is gone.", "Does not exist", "Confirm that you are human to proceed.", "We have detected unusual activity from your computer network.", "Attention required!", "Security check", "Unknown error", "Login failed", "Out of order, please come back later.",
        "500 Internal Server Error", "The server encountered an internal error or misconfiguration and was unable to complete your request.", "An unexpected error occurred while processing your request.", "Something went wrong.", "Something went wrong on our end, please try again later.", "We're sorry, but something went wrong.", "Oops! Something broke.", "An error has occurred.", "Sorry, an error occurred; our team has been notified.", "Please try again in a few minutes.", "Traceback (most recent call last):", "Uncaught exception: call stack", "Fatal error: uncaught exception thrown", "Error establishing a database connection", "There has been a critical error on this website.", "Application error: a client-side exception has occurred.", "Internal error",
        "502 Bad Gateway", "504 Gateway Time-out", "503 Service Unavailable", "The server is temporarily unable to service your request due to maintenance downtime or capacity problems.", "The upstream server did not respond in time.", "The web server reported a gateway error.", "The service is currently unavailable.", "The site is temporarily down for scheduled maintenance and will be back soon.", "We are performing maintenance; please check back shortly.", "Our servers are overloaded at the moment.", "The backend closed the connection without an answer.", "Web server is down, error code 521",
        "This site can't be reached.", "The connection has timed out.", "Connection timed out", "The request timed out.", "Connection reset by peer.", "Unable to connect.", "Failed to load resource: the server responded with an error", "Failed to load this page; check your internet connection.", "Could not load the content, tap to retry.", "Error loading the rest of the page.", "Reload the page in a few seconds.", "Retry?",
        "403 Forbidden", "You don't have permission to access this resource.", "Access denied", "Access to this page has been denied.", "You are not authorized to view this page.", "401 Unauthorized", "Authorization required", "This request was blocked by the security rules.", "Your access to this site has been blocked by its owner.", "This repository is private or has been disabled.", "The owner of this content has restricted access; it may be private.", "Your IP address has been temporarily blocked due to unusual traffic.",
        "Please log in to continue.", "You must be logged in to view this content.", "Sign in to read the rest of this document.", "Your session has expired, please sign in again.", "Login required", "Subscribe to continue reading this article.", "Your account is not a member of this space.",
        "429 Too Many Requests", "You have exceeded the rate limit, wait a few seconds and try again.", "API rate limit exceeded for your address", "Request limit reached",
        "Checking your browser before accessing the site.", "This process is automatic and should take about five seconds.", "Please verify that you are a human.", "Please complete the captcha to prove you are not a robot.", "Pardon our interruption: we think you might be a bot using automated tools.", "Enable cookies and reload the page.", "Just a moment...",
        "File or directory not found", "The server response took too long.", "The page isn't working right now.", "400 Bad Request", "Your browser sent a request that this server could not understand.", "405 Method Not Allowed", "Error Code: NoSuchKey, The specified key does not exist.", "error message status 500 detail", "Invalid request", "Your connection is not private.",
        "Seite nicht gefunden", "Die gesuchte Seite existiert leider nicht mehr.", "Die angeforderte Adresse wurde auf diesem Server nicht gefunden.", "Es ist ein Fehler aufgetreten, bitte versuchen Sie es später erneut.", "Zugriff verweigert", "Sie haben keine Rechte für diesen Bereich.", "Fehler: die Seite ist nicht erreichbar.", "Ihre Sitzung ist abgelaufen.", "Bitte melden Sie sich an, um fortzufahren.", "Der Server ist derzeit nicht erreichbar.", "Interner Serverfehler", "Die Seite konnte leider nicht gefunden oder geladen werden.", "Wegen Wartungsarbeiten ist diese Seite vorübergehend nicht verfügbar.",
        "页面不存在", "无法访问此网站", "网页打不开", "内容已删除", "登录已过期,请重新登录", "验证您是人类", "您访问的页面不存在或已被删除", "页面未找到,请返回首页", "服务器错误,请稍后再试", "服务器繁忙,请稍候重试", "访问被拒绝", "没有权限访问此页面", "请先登录后再查看", "请求超时", "系统维护中", "出错了", "网络连接失败,请检查网络",
    ],
    "scripts": [
        "You need to enable JavaScript to run this app.", "Please enable JavaScript to view this page.", "Please enable JavaScript in your browser to continue using this site.", "JavaScript is required to use this website.", "This website requires JavaScript to work properly.", "This site needs JavaScript enabled to function correctly.",
        "Your browser must have JavaScript activated to display this content.", "JavaScript is disabled in your browser.", "It appears that JavaScript is turned off in your browser settings.", "JavaScript seems to be switched off; turn on scripts and reload the page.", "We're sorry but this application doesn't work properly without JavaScript enabled; please enable it to continue.",
        "Without JavaScript this page cannot be shown and some features will not be available.", "For full functionality of this site it is necessary to enable JavaScript.", "Here are the instructions how to enable JavaScript in your web browser.", "Your browser does not support JavaScript, so nothing will load here.", "Please turn on JavaScript and cookies, then refresh.", "Enable JavaScript and cookies to continue", "JavaScript must be enabled in order for you to use this tool.",
        "Allow scripts to run on this page.", "This page relies on client-side scripting, which your browser blocks.", "You have disabled scripts, so parts of this page stay empty.", "Loading... please wait; if this page does not load, check that scripts are enabled in your settings.", "Activate JavaScript for a better experience.", "We've detected that JavaScript is disabled; please use a supported browser to continue.", "Please disable your ad blocker and allow JavaScript to see the comments.", "noscript: scripts required", "Some features of this site will not work with JavaScript off.", "The form needs JavaScript; if you see this message, your browser does not run it.", "Best viewed with JavaScript enabled in a modern browser.", "This web app makes use of JavaScript.", "JavaScript required", "Enable scripts to continue.", "Map, chart or player cannot load without JavaScript.", "To visit the shop or sign in, allow JavaScript first.",
        "Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite anzuzeigen.", "Diese Seite benötigt JavaScript, um zu funktionieren.", "Ihr Browser unterstützt kein JavaScript oder es ist deaktiviert.", "Ohne JavaScript kann der Inhalt nicht angezeigt werden.", "Für diese Anwendung muss JavaScript eingeschaltet sein.", "Für diese Website ist JavaScript erforderlich.", "Schalten Sie JavaScript in den Browsereinstellungen ein.", "Sie haben JavaScript deaktiviert.", "Nur mit JavaScript nutzbar; die Website funktioniert sonst nicht.",
        "请启用 JavaScript 后继续访问", "您的浏览器不支持 JavaScript,请开启后刷新页面", "需要启用脚本才能显示本页内容", "本网站需要 JavaScript 才能正常运行", "浏览器已禁用脚本", "请在浏览器设置中开启 JavaScript 以查看内容",
    ],
}

SEEN = {
    "template": [
        "Describe the finding in two sentences.", "Add a description of the unit here.", "Replace this paragraph with your own text.", "Sample text goes here.", "Hier steht ein Beispieltext.", "此处填写说明", "Diese Vorlage wurde nicht ausgefüllt",
        "include not found", "Notice: undefined variable title owner unit date in template line 9", "stub draft placeholder: no content for this section", "undefined undefined undefined NaN",
    ],
    "filler": ["Lorem ipsum dolor vexa pulsa ostra corva nemit quiba runtam tenor arvit morsu velum sedil laten", "asdf asdf qwer asdf", "blah blah blah, more blah", "Text text text text"],
    "error": [
        "The requested page could not be located on this server.", "The upstream did not answer in time.", "Repository access blocked.", "Contact the owner of this content.", "Your account has no seat in this space.", "unusual traffic from your network", "Read more... (login required to load the rest)",
        "This takes about five seconds.", "The upstream closed the connection.", "The backend gave no answer.", "Check your connection.", "Your address is limited for the next 9 seconds.", "Die angeforderte Adresse existiert nicht (mehr).", "服务器繁忙,请稍后再试。", "请返回首页。", "content unavailable: request timed out",
        "Access to this page has been denied because we believe you are using automation tools.", "you lack permission to open this page thread document report artifact file wiki entry", "ask the owner of this page thread document report artifact file wiki entry for access",
        "Error Code NoSuchKey Message The key is not there.", "Error: failed to load the rest of this page.", "handler", "We could not load this document.", "Reload in 9 seconds.", "Our servers are busy right now.", "We are down for maintenance and will be back shortly.", "Something broke on our side.", "The report you asked for is not here.", "We could not load this artifact.", "We could not load this thread.", "The artifact you asked for was deleted.", "The artifact you asked for could not be located.", "The thread you asked for was deleted.", "The thread you asked for could not be located.", "The thread you asked for is not here.", "The document you asked for was deleted, has moved or never existed.",
    ],
    "scripts": [
        "You need to allow scripts in order to view this thread.", "This site works only with scripts turned on.", "Check the settings of your browser and reload.", "Some parts of this page will not load.", "Loading... if nothing appears, turn on JS and cookies.", "You have scripts switched off, so there is nothing to show.",
        "Our wiki needs client-side scripting.", "The log console relies on scripts.", "The diff view does not run without scripts.", "Activate scripts for this site.", "Switch on scripts and reload.", "Allow scripts and reload.", "This viewer needs scripts.", "This app does not run without scripts.", "Enable scripts or use another browser.", "Turn on scripts in your settings to go on.",
        "Heads up: without scripts, nothing will load here.", "Note: without scripts, this page stays empty.", "Sorry, without scripts, we cannot show the content.", "您的浏览器不支持脚本,无法显示内容。", "请启用 JavaScript 后刷新页面。",
    ],
}

GENUINE = [
    "Our report template prints {{name}} and {{name}} per row, and the writer fills both from the header.",
    "The podspec sets ${name} as a search path, which the parser expands before it compares.",
    "In the wizard the fields [NAME] and [NAME] are filled by the user before anything is stored.",
    "Tokens such as __title__ and @@name@@ are replaced by the preprocessor, hence the literal never ships.",
    "Bundle ids such as ${name} are resolved from the release settings.",
    "The format %%name%% is a log string and carries a value.",
    "The sample target ships a lorem ipsum string table, so its literals are skipped by the scan.",
    "There is a TODO that asks for a placeholder image; it does not touch the defaults.",
    "The help viewer falls back to a noscript block, since the web view may have JavaScript disabled.",
    "The embedded help shows the sentence \"Please enable JavaScript to continue\" on old systems, and we only count its defaults.",
    "When the artifact has expired the download ends with 404 Not Found and the job is marked as not collected.",
    "A page not found answer clears the cached date and nothing else.",
    "The class logs \"Access denied\" whenever the keychain is locked, and that line is not a site.",
    "When the session has expired the app asks the user to sign in again and writes no key.",
    "The rate limit counts too many requests per minute with the uptime clock.",
    "The retry wrapper treats 502 Bad Gateway and 503 Service Unavailable alike.",
    "The handler returns 404 Not Found when the record is missing and 403 Forbidden when the caller lacks the role.",
    "We render the page with JavaScript disabled in the test to check that the fallback works.",
    "If the connection times out, the client retries three times and then logs an internal server error.",
    "Designers paste lorem ipsum into the mock-up until the copy is ready.",
    "The template engine replaces {{name}} with the value of the variable.",
    "See the article about how to fix the error page not found in nginx.",
    "The login page shows an access denied message after three wrong passwords.",
    "Users who turn JavaScript off still see the static menu.",
]
